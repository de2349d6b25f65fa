"""Token counts through a digest cache.

A text is known by the SHA-256 of its normalised content, a tokenizer by that of its file and its library's name and
version. The cache is a folder of Parquet files, one sub-folder for each tokenizer, with rows (digest, n_tokens). Texts'
digests are joined to it; each digest that is missing is encoded once, and its count is appended. Counts of all texts
then come from the cache.

Normalised content is the text with each run of ASCII white space as one space and none at the ends, where the tokenizer
drops white space between words (`blank_free`); else the text itself. Lower case or other forms are left to the
tokenizer, since special strings within texts are found before it applies them.

A null text is empty (0 tokens for a tokenizer without added ones). Repeated rows, null and repeated ids are kept, one
result row each; other columns are ignored; an empty table gives no rows. A `blank_free` tokenizer encodes words between
spaces, each once as long as a task holds its count, so no text is encoded whole. Two runs that append the same digest do
no harm: it has one count.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, exists, materialise, shared_dir, table, text_of, tidy

LIMIT = 2048
#: Characters of texts that are encoded at once, and characters of words (50 more each) whose counts a task holds.
CHUNK, HELD = 1 << 18, 1 << 25
#: Missing digests up to which they are sent to the tasks that read the texts (under 200 MB in memory).
BROADCAST_ROWS = 1_000_000
_BLANKS = "[\\x20\\x09-\\x0D]+"


def library_of(path: str) -> str:
    kinds = {".json": "tokenizers", ".model": "sentencepiece"}
    kind = os.path.splitext(path)[1]
    if kind not in kinds:
        raise ValueError(f"no library for {path}: a .json or .model file is needed")
    return kinds[kind]


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's content and its library's version: counts of another version are not reused."""
    import importlib.metadata

    library = library_of(path)
    with open(path, "rb") as f:
        content = f.read()
    return hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode() + content).hexdigest()


def counter(path: str):
    """A function from texts to their numbers of tokens, as the library gives them without any added ones."""
    if library_of(path) == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Encoder:
    """Numbers of tokens of texts. Where the tokenizer drops white space between words, a text's tokens are those of its
    words between single spaces, and each word is encoded once while its count is held; special strings hold no space."""

    def __init__(self, path: str, blank_free: bool, held: int = HELD) -> None:
        self.count, self.blank_free, self.most = counter(path), blank_free, held
        self.known: dict[str, int] = {}
        self.size = 0

    def totals(self, texts: list[str]) -> list[int]:
        if not self.blank_free:
            return self.count(texts)
        words = [t.split(" ") for t in texts]
        new = list(set().union(*words) - self.known.keys())
        self.known.update(zip(new, self.count(new)))
        self.size += sum(map(len, new)) + 50 * len(new)
        out = [sum(map(self.known.__getitem__, w)) for w in words]
        if self.size > self.most:
            self.known, self.size = {}, 0
        return out


def _encoded(texts: DataFrame, path: str, blank_free: bool) -> DataFrame:
    """(digest, n_tokens) of (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, blank_free)
        for batch in batches:
            totals: list[int] = []
            held: list[str] = []
            size = 0
            for text in batch.column(1):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= CHUNK:
                    totals += encoder.totals(held)
                    held, size = [], 0
            totals += encoder.totals(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(tidy(run), "digest binary, n_tokens long")


class TokenCache:
    """Counts under `folder`, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str, blank_free: bool = False) -> None:
        bound_batches(spark)
        self.spark, self.path, self.blank_free = spark, tokenizer, blank_free
        self.version = tokenizer_digest(tokenizer)
        self.folder = f"{folder.rstrip('/')}/tokenizer={self.version}"

    def counts(self) -> DataFrame | None:
        """(digest, n_tokens) of what is cached, each digest once."""
        if not exists(self.spark, self.folder):
            return None
        held = self.spark.read.schema("digest binary, n_tokens long").option("recursiveFileLookup", "true").parquet(self.folder)
        return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def content(self, text_col: str):
        text = text_of(text_col)
        return F.trim(F.regexp_replace(text, _BLANKS, " ")) if self.blank_free else text

    def extend(self, df: DataFrame, digests: DataFrame, text_col: str = "text") -> int:
        """Encodes the texts of df whose digests (rows: digest) are not cached, each once, and appends their counts;
        returns how many there were."""
        wanted, cached = digests.select("digest").distinct(), self.counts()
        missing = wanted if cached is None else wanted.join(cached, "digest", "left_anti")
        missing = materialise(missing, "missing-digests")
        n = missing.count()
        if n:
            texts = df.select(self.content(text_col).alias("text")).select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text")
            # Few missing ones are sent to the texts. Else tasks first reduce their texts to one of each digest, so that
            # copies don't meet in one task, and only then meet the missing ones.
            if n <= BROADCAST_ROWS:
                texts = texts.join(F.broadcast(missing), "digest", "left_semi")
            texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
            if n > BROADCAST_ROWS:
                texts = texts.join(missing, "digest", "left_semi")
            _encoded(texts, self.path, self.blank_free).write.parquet(f"{self.folder}/{uuid.uuid4().hex}")
        discard(missing)
        return n

    def count_tokens(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
        """(doc_id, n_bytes, n_tokens, over_limit): a row for each of df."""
        digest = F.unhex(F.sha2(self.content(text_col).cast("binary"), 256))
        keys = df.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), digest.alias("digest"))
        keys = materialise(keys, "digests")
        self.extend(df, keys, text_col)
        counts = self.counts()
        if counts is None:  # no rows at all
            counts = self.spark.createDataFrame([], "digest binary, n_tokens long")
        out = keys.join(counts, "digest")
        return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12(spark, sf_dir: str) -> DataFrame:
    """The cache is kept where `spark.millrace.tokenCache` names a folder, else it begins empty."""
    import public_tokenizers

    folder = spark.conf.get("spark.millrace.tokenCache", None) or f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/token-cache-{uuid.uuid4().hex}"
    cache = TokenCache(spark, folder, public_tokenizers.path("word_bpe_49k.json"), blank_free=True)
    return cache.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
