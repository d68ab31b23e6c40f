"""Records of several sources combined so that each source has its target share of all tokens.

Tokens are summed by source and hash bucket; from the sums follows the largest mix in which no record is used more often
than its source allows. Each source then uses all its records a whole number of times, and those below a hash threshold once
more. The threshold is nested: only the bucket that the budget ends in is divided further, until the remainder is below one
record; smaller records then fill the remainder in the same way, a few times over. Records are filtered by the threshold; nothing is sorted.

Defined results: texts that are null or without tokens are never chosen. Sources without a target, with a share of null or 0
or with ``max_repeats`` below 1 contribute nothing; sources with a target but without records can reach no share and are
left out of the sum (their shares are reported as 0). Records of one id share one hash and are chosen together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import VOCABULARY, token_sizes
from ledgerloom.session import written

#: Bits of the hash that one level of buckets takes, and levels; together they take the whole 60 bits used.
BITS, LEVELS = 12, 5


END = 1 << (BITS * LEVELS)


def _shift(level: int) -> int:
    return BITS * (LEVELS - 1 - level)


def _thresholds(pool: DataFrame, source: str, budget: dict[str, float]) -> dict[str, tuple[int, float]]:
    """(key, budget left) per source: the records below the key use up the budget as far as whole records can. Sums of
    buckets are cumulated and cut on the executors; the driver gets one row per source and level."""
    spark = pool.sparkSession
    left, edge, inside, active = dict(budget), dict.fromkeys(budget, END), dict.fromkeys(budget), set(budget)
    upto = Window.partitionBy(source).orderBy("b")
    for level in range(LEVELS):
        bounds = spark.createDataFrame([(s, left[s], inside[s]) for s in active], f"`{source}` string, budget double, bucket long")
        part = pool.join(F.broadcast(bounds), source)
        if level:
            part = part.where(F.shiftright("key", _shift(level - 1)) == F.col("bucket"))
        sums = part.groupBy(source, "budget", F.shiftright("key", _shift(level)).alias("b")).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("k"))
        sums = sums.withColumn("upto", F.sum("n").over(upto))
        ends = sums.groupBy(source).agg(
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("budget"), F.col("upto"))), F.lit(0)).alias("used"), F.min(F.when(F.col("upto") > F.col("budget"), F.struct("b", "k"))).alias("cut")
        )
        found = {r[source]: r for r in ends.collect()}
        for s in list(active):
            r = found.get(s)
            if r is None or r.cut is None:
                left[s] -= r.used if r else 0
                edge[s] = inside[s] + 1 << _shift(level - 1) if level else END
                active.discard(s)
                continue
            left[s] -= r.used
            inside[s], edge[s] = r.cut.b, r.cut.b << _shift(level)
            if r.cut.k == 1:
                active.discard(s)
        if not active:
            break
    return {s: (edge[s], left[s]) for s in budget}


def mix(docs: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", share: str = "target_share", repeats: str = "max_repeats", vocabulary: str = VOCABULARY, max_sources: int = 10_000, passes: int = 6) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): chosen records as (source, doc_id, tokens, repeats), and per source its target and reached share.

    More than ``max_sources`` targets are refused, as they are held by the driver.
    """
    spark = docs.sparkSession
    wanted = {}
    for r in targets.select(F.col(source).alias("s"), F.col(share).cast("double").alias("w"), F.col(repeats).cast("int").alias("m")).where("s is not null").limit(max_sources + 1).collect():
        wanted[r.s] = (r.w or 0.0, r.m or 0)
    if len(wanted) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    usable = [s for s, (w, m) in wanted.items() if w > 0 and m >= 1]
    rows = docs.where(F.col(id).isNotNull() & F.col(source).isin(usable)) if usable else docs.limit(0)
    key = F.shiftrightunsigned(F.xxhash64(id), 64 - BITS * LEVELS)
    sized = written(token_sizes(rows, text, [id, source], vocabulary).where("tokens > 0").withColumn("key", key))

    total = {r[source]: r.n for r in sized.groupBy(source).agg(F.sum("tokens").alias("n")).collect()}
    weight = sum(wanted[s][0] for s in total) or 1.0
    whole = min((wanted[s][1] * n * weight / wanted[s][0] for s, n in total.items()), default=0.0)
    base, left = {}, {}
    for s, n in total.items():
        budget = whole * wanted[s][0] / weight
        base[s] = min(int(budget // n + 1e-9), wanted[s][1])
        left[s] = max(0.0, budget - base[s] * n) if base[s] < wanted[s][1] else 0.0
    # (source, lowest key, key that ends the range, smallest and largest record): the records used once more
    ranges: list[tuple[str, int, int, int, int]] = []
    low, least, most = dict.fromkeys(total, 0), dict.fromkeys(total, 1), dict.fromkeys(total, 1 << 62)
    used_up: set[str] = set()
    for step in range(passes):
        active = {s: left[s] for s in total if left[s] >= least[s]}
        if not active:
            break
        pool = sized
        if step:
            # what a record too large for the remainder leaves over goes to smaller ones
            for s in active:
                most[s] = max(least[s], int(left[s] if s in used_up else left[s] / 2))
            bounds = spark.createDataFrame([(s, low[s], least[s], most[s]) for s in active], f"`{source}` string, lowest long, least long, most long")
            pool = sized.join(F.broadcast(bounds), source).where("key >= lowest and tokens between least and most").drop("lowest", "least", "most")
        for s, (edge, rest) in _thresholds(pool, source, active).items():
            ranges.append((s, low[s], edge, least[s], most[s]))
            left[s] = rest
            if edge == END:
                least[s] = most[s] + 1
                used_up.add(s)
            else:
                low[s] = edge
                used_up.discard(s)
    parts: dict[str, list] = {s: [] for s in total}
    for s, *part in ranges:
        parts[s].append(tuple(part))
    cuts = spark.createDataFrame([(s, base[s], parts[s]) for s in total], f"`{source}` string, base int, parts array<struct<lo:long,hi:long,least:long,most:long>>")
    once_more = F.exists("parts", lambda x: (x["lo"] <= F.col("key")) & (F.col("key") < x["hi"]) & F.col("tokens").between(x["least"], x["most"]))
    chosen = sized.join(F.broadcast(cuts), source).withColumn("repeats", F.col("base") + F.when(once_more, 1).otherwise(0))
    chosen = chosen.where("repeats > 0").select(source, id, "tokens", "repeats")
    reached = chosen.groupBy(source).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_used"), F.count(F.lit(1)).alias("records"), F.max("repeats").alias("most_repeats"))
    reached = written(reached)
    of_all = reached.agg(F.sum("tokens_used").alias("all_tokens"))
    shares = (
        targets.select(source, F.col(share).alias("target_share"), F.col(repeats).alias("max_repeats")).join(reached, source, "left").crossJoin(F.broadcast(of_all))
    )
    shares = shares.select(
        source, "target_share", F.coalesce(F.col("tokens_used") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
    )
    return chosen, shares
