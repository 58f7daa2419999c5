"""Measurements: readers of benchmark logs, best-of and ratio summaries, a report that is refreshed in parts, pinned digests."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lines of the four kinds of log. Groups: what the fields below are read from.
TIMED = r"^Benchmark(Match|MatchGray)/(\w+?)(?:-(\d+))?\s+\d+\s+([\d.]+) ns/op"
NATIVE, NATIVE_GREY = r"^(\w+)\s+([\d.]+) ms\s+([\d.]+) ms", r"^gray:(\w+)\s+([\d.]+) ms"
MEMORY = r"impl=(\w+).*peakHWM=(\d+) kB"
PARITY = r"^scene=(\w+) worst_abs=([\d.eE+-]+)"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def group(pattern: str, k: int) -> Column:
    return F.regexp_extract("value", pattern, k)


def timings(logs: DataFrame) -> DataFrame:
    """(kind, scene, cpus, ms) of benchmark lines; without a number of CPUs it was one."""
    own = logs.where(F.col("value").rlike(TIMED))
    cpus = F.when(group(TIMED, 3) == "", F.lit("1")).otherwise(group(TIMED, 3)).cast("int")
    return own.select(group(TIMED, 1).alias("kind"), group(TIMED, 2).alias("scene"), cpus.alias("cpus"), (group(TIMED, 4).cast("double") / 1e6).alias("ms"))


def native_timings(logs: DataFrame) -> DataFrame:
    """(kind, scene, ms) of native lines, colour and grey."""
    colour = logs.where(F.col("value").rlike(NATIVE)).select(F.lit("color").alias("kind"), group(NATIVE, 1).alias("scene"), group(NATIVE, 2).cast("double").alias("ms"))
    grey = logs.where(F.col("value").rlike(NATIVE_GREY)).select(F.lit("gray").alias("kind"), group(NATIVE_GREY, 1).alias("scene"), group(NATIVE_GREY, 2).cast("double").alias("ms"))
    return colour.unionByName(grey)


def memory(logs: DataFrame) -> DataFrame:
    """(impl, mb): the highest memory of each."""
    return logs.where(F.col("value").rlike(MEMORY)).groupBy(group(MEMORY, 1).alias("impl")).agg((F.max(group(MEMORY, 2).cast("double")) / 1024).alias("mb"))


def parities(logs: DataFrame) -> DataFrame:
    """(scene, worst_abs)."""
    return logs.where(F.col("value").rlike(PARITY)).select(group(PARITY, 1).alias("scene"), group(PARITY, 2).cast("double").alias("worst_abs"))


def best_of(times: DataFrame, *keys: str) -> DataFrame:
    """The least of repeated measurements: (*keys, ms, runs)."""
    return times.groupBy(*keys).agg(F.min("ms").alias("ms"), F.count("*").alias("runs"))


def ratios(times: DataFrame, ours: str, theirs: str, by: str = "impl") -> DataFrame:
    """One row (least, most, scenes): how many times faster ours is than theirs, over the scenes that have both; none give nulls."""
    wide = times.groupBy("scene").agg(F.min(F.when(F.col(by) == ours, F.col("ms"))).alias("a"), F.min(F.when(F.col(by) == theirs, F.col("ms"))).alias("b"))
    both = wide.where("a is not null and b is not null").withColumn("r", F.col("b") / F.col("a"))
    return both.agg(F.min("r").alias("least"), F.max("r").alias("most"), F.count("*").alias("scenes"))


def refreshed(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """A report with what was measured again replaced and the rest kept. Both have the same columns."""
    return before.join(after.select(*keys).distinct(), list(keys), "left_anti").select(*before.columns).unionByName(after)


def markdown(rows: Iterable, columns: list[str]) -> str:
    """A table of a report's rows, which are few; numbers with one decimal."""
    cell = lambda v: "" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v)
    body = ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *body]) + "\n"


def write_report(report: DataFrame, path: str, *order: str) -> str:
    """Writes a report as JSON lines and returns it as a table in Markdown."""
    report.write.mode("overwrite").json(path)
    return markdown(report.orderBy(*order).collect(), report.columns)  # a row for each scene measured


def pinned(digests: dict[str, str], before: str | None, reason: str) -> str:
    """The text of a table of pinned digests; a change needs a reason, and not the one that is there already."""
    old = json.loads(before) if before else {"reason": None, "digests": {}}
    if not reason.strip():
        raise ValueError("pinning digests needs a reason")
    if old["digests"] != digests and old["reason"] == reason.strip():
        raise ValueError("the digests differ, but the reason is the one given last time")
    return json.dumps({"reason": reason.strip(), "digests": digests}, indent=1, sort_keys=True) + "\n"
