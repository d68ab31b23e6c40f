"""Roll-ups of run events: timings, devices, workers, confidences, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = (("high", 0.90), ("good", 0.75), ("fair", 0.50))


def nearest_rank_by(df: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """(keys, value): the value at index ``int(share * n)`` of the sorted values, not interpolated; distinct values are counted, so that
    no group is held in one place."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_n").over(Window.partitionBy(*keys))
    rank = F.least((F.lit(share) * total).cast("long"), total - 1)
    x = counts.withColumn("_upto", F.sum("_n").over(w)).withColumn("_rank", rank)
    return x.where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank"))).select(*keys, value)


def stage_timings(df: DataFrame, phase: str, duration: str) -> DataFrame:
    return df.groupBy(phase).agg(F.sum(duration).alias("total"), F.count(F.lit(1)).alias("calls"))


def confidence_bucket(c: Column) -> Column:
    out = F.lit("low")
    for name, least in reversed(BUCKETS):
        out = F.when(c >= least, name).otherwise(out)
    return out


def confidence_histogram(df: DataFrame, confidence: str) -> DataFrame:
    """All four buckets with their counts, in one row."""
    b = confidence_bucket(F.col(confidence))
    return df.where(F.col(confidence).isNotNull()).agg(*[F.count_if(b == n).alias(n) for n in ("high", "good", "fair", "low")])


def select_page_level(df: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """Within groups that have any row of level 'page', only those; others whole."""
    any_page = F.max(F.when(F.col(level) == "page", 1).otherwise(0)).over(Window.partitionBy(*keys))
    return df.withColumn("_p", any_page).where((F.col("_p") == 0) | (F.col(level) == "page")).drop("_p")


def keep_newest(df: DataFrame, key: str, when: str, limit: int) -> DataFrame:
    """The newest row of each key, and of those the ``limit`` newest: what an upsert with a bound leaves. The limit is the
    feature."""
    order = [c for c in df.columns if c not in (key, when)]
    one = df.groupBy(key).agg(F.max(F.struct(when, *order)).alias("_r")).select(key, "_r.*")
    return one.orderBy(F.desc(when), key).limit(limit)


def evict(df: DataFrame, size: str, used: str, id: str, capacity: int, salt_days: bool = True) -> DataFrame:
    """Entries to drop, least recently used first, so that the rest fits ``capacity``: a running sum over days, then within
    the day the limit falls in."""
    day = F.to_date(used)
    by_day = df.groupBy(day.alias("_day")).agg(F.sum(size).alias("_s"))
    newer = F.coalesce(F.sum("_s").over(Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = by_day.select("_day", newer.alias("_newer"))
    inner = F.sum(size).over(Window.partitionBy("_day").orderBy(F.desc(used), id).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = df.withColumn("_day", day).join(before, "_day").withColumn("_kept", F.col("_newer") + inner)
    return x.where(F.col("_kept") > capacity).drop("_day", "_newer", "_kept")
