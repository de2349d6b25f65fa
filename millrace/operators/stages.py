"""Stage runner, artifact checks and progress."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Stage:
    name: str
    run: Callable[[], object]
    produced: Callable[[], bool] = lambda: False
    needs: tuple[str, ...] = field(default_factory=tuple)
    minutes: float = 0.0


def deadline(text: str) -> datetime:
    """An ISO time; without a zone it is UTC."""
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def run_stages(stages: list[Stage], until: datetime | None = None, now: Callable[[], datetime] | None = None) -> list[tuple[str, str, float]]:
    """(name, status, minutes) of each stage in order: skipped if produced, if a need failed, or if the clock has no room
    for it; a failure doesn't stop the others."""
    now = now or (lambda: datetime.now(timezone.utc))
    done: dict[str, str] = {}
    out = []
    for stage in stages:
        began = time.monotonic()
        if stage.produced():
            status = "skipped"
        elif any(done.get(n) not in ("ok", "skipped") for n in stage.needs):
            status = "skipped (deps)"
        elif until is not None and (until - now()).total_seconds() / 60 < stage.minutes:
            status = "skipped (clock)"
        else:
            try:
                stage.run()
                status = "ok"
            except Exception:
                status = "FAILED"
        done[stage.name] = status
        out.append((stage.name, status, (time.monotonic() - began) / 60))
    return out


def artifact_check(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"), F.countDistinct("config").alias("n_configs"), F.countDistinct("config", "id").alias("n_ids"),
        F.countDistinct("config", "book").alias("n_books"), F.count_if(F.col("duration") <= 0).alias("n_empty"),
    )


def checks(spark: SparkSession, rows: list[tuple[str, bool, str]], warn: tuple[str, ...] = ()) -> DataFrame:
    """(check, status, detail) with ok, WARN or FAIL."""
    named = [(name, "ok" if fine else "WARN" if name in warn else "FAIL", detail) for name, fine, detail in rows]
    return spark.createDataFrame(named, "check string, status string, detail string")


def doctor(spark: SparkSession, needed: dict[str, DataFrame | None], wanted: dict[str, DataFrame | None], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(check, status, detail) of artifacts: tables that are needed (missing: FAIL) or wanted (missing: WARN), with
    their rows and configs, and of the columns that tables must have."""
    rows, warn = [], []
    for name, table in [*needed.items(), *wanted.items()]:
        if table is None:
            rows.append((name, False, "missing"))
            warn += [name] if name in wanted and name not in needed else []
            continue
        held = table.agg(F.count("*").alias("n"), (F.countDistinct("config") if "config" in table.columns else F.lit(None)).alias("c")).first()
        rows.append((name, True, f"{held['n']:,} rows" + ("" if held["c"] is None else f", {held['c']} configs")))
    for name, want in (columns or {}).items():
        table = needed.get(name) if needed.get(name) is not None else wanted.get(name)
        gone = sorted(set(want) - set(table.columns if table is not None else []))
        rows.append((f"{name} columns", not gone, f"missing {gone}" if gone else "/".join(want)))
    return checks(spark, rows, tuple(warn))


def real_time_factor(seconds: Column, samples: Column, rate: Column) -> Column:
    """Seconds of work for each second of audio."""
    return seconds / F.greatest(samples / rate, F.lit(1e-9))


# Classes in the order in which they are sought, with their TFLOPS, and the default.
DEVICE_CLASSES = {"T4": 65, "P100": 19, "V100": 125, "A100": 312, "L4": 121, "H100": 989, "H200": 989, "A10G": 125, "RTX": 165}
UNKNOWN_DEVICE = ("unknown", 65.0)


def device_class(name: Column) -> tuple[Column, Column]:
    """(class, TFLOPS) of a device's name: the first class that it holds, in any case and spacing."""
    plain = F.replace(F.upper(name), F.lit(" "), F.lit(""))
    found = F.filter(F.array(*map(F.lit, DEVICE_CLASSES)), lambda c: F.contains(plain, c))
    speed = F.create_map(*[F.lit(v) for k, t in DEVICE_CLASSES.items() for v in (k, float(t))])
    first = F.get(found, F.lit(0))
    return F.coalesce(first, F.lit(UNKNOWN_DEVICE[0])), F.coalesce(F.try_element_at(speed, first), F.lit(UNKNOWN_DEVICE[1]))


def extrapolated_hours(hours: Column, epochs: Column, audio_seconds_per_second: Column, here: Column, there: Column) -> tuple[Column, Column]:
    """(hours of training here, hours on a device of other speed) at a measured rate."""
    own = hours * epochs / audio_seconds_per_second
    return own, own * here / there


def progress_rate(points: DataFrame, key: str = "user_id") -> DataFrame:
    """Steps a second between the first and the last point; with no time between them, steps so far over 1 second."""
    ends = points.groupBy(key).agg(
        F.min_by("step", F.struct("seconds", "step")).alias("first"), F.max_by("step", F.struct("seconds", "step")).alias("last"),
        F.min("seconds").alias("t0"), F.max("seconds").alias("t1"),
    )
    span = F.col("t1") - F.col("t0")
    rate = F.when(span > 0, (F.col("last") - F.col("first")) / span).otherwise(F.col("last").cast("double"))
    return ends.select(key, "first", "last", rate.alias("rate"))


def newest_step(names: DataFrame, column: str = "name") -> DataFrame:
    """The highest step of names like ...step<digits>.pt, and the name that has it."""
    step = F.regexp_extract(column, r"step(\d+)\.pt$", 1).try_cast("long")
    told = names.select(F.col(column).alias("name"), step.alias("step")).where("step is not null")
    return told.agg(F.max("step").alias("step"), F.max_by("name", F.struct("step", "name")).alias("name"))
