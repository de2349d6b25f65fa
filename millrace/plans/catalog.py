"""Registry of the queries and of the SQL that checks them."""

from .base import ORACLE, QUERIES
from . import corpus, evaluation, texts  # noqa: F401
