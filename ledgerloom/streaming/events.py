"""The event log as a stream: windows, duplicates, sessions, the life of spans, and the quarantine of failing sources.

``lateness`` is a parameter everywhere. Without it no event is ever too late, and state is kept for every window or id; with it
state is given up after that time, and later events are left out. ``drain`` says how many were.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.session import kept


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New event files at ``path``, a file or folder, as they arrive. The path goes in as a pattern, since a stream takes a
    plain one for a folder."""
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("at", F.col("ts").cast("timestamp"))


def _marked(stream: DataFrame, lateness: str | None) -> DataFrame:
    return stream.withWatermark("at", lateness) if lateness else stream


def hourly(stream: DataFrame, lateness: str | None = None, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by window (of ``width``, sliding by ``slide``) and type."""
    counts = _marked(stream, lateness).groupBy(F.window("at", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    """Events of a user without a pause of ``gap``."""
    grouped = _marked(stream, lateness).groupBy(F.session_window("at", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def without_repeats(stream: DataFrame, id: str = "event_id", lateness: str | None = None) -> DataFrame:
    """Each event once; with ``lateness``, if its repeats arrive within that time."""
    return _marked(stream, lateness).dropDuplicatesWithinWatermark([id]) if lateness else stream.dropDuplicates([id])


def span_states(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(user_id, events, last_type, last_us): running state of each key, kept across batches and, with ``idle_ms``, dropped
    after as long a silence. Such a clock never comes to rest, so a query that is to end takes none."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, kind, last = state.get if state.exists else (0, None, -(1 << 62))
        for f in frames:
            n += len(f)
            f = f.sort_values(["us", "event_id"])
            if len(f) and int(f["us"].iloc[-1]) >= last:
                last, kind = int(f["us"].iloc[-1]), f["event_type"].iloc[-1]
        state.update((n, kind, last))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "last_type": [kind], "last_us": [last]})

    rows = stream.select("user_id", "event_id", "event_type", F.unix_micros("at").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(
        update, "user_id long, events long, last_type string, last_us long", "events long, last_type string, last_us long", "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    )


def span_life(stream: DataFrame, orphan_us: int, opens: str = "open", closes: str = "close") -> DataFrame:
    """(span_id, opened_us, closed_us, status) for each event: spans that open and close, in whatever order the two arrive. A
    close without an open is UNMATCHED until its open comes; a span that is still open ``orphan_us`` after it opened, by the
    latest event of its own run, is ORPHANED, and CLOSED again if its close comes after all.

    ``stream`` has run_id, span_id, kind and us. State is kept by run, so the clock of one run doesn't end the spans of others."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, opened, closed, now = ([list(x) for x in state.get[:3]] + [state.get[3]]) if state.exists else ([], [], [], -(1 << 62))
        spans = {i: [o, c] for i, o, c in zip(ids, opened, closed)}
        for f in frames:
            for i, kind, us in zip(f["span_id"].tolist(), f["kind"].tolist(), f["us"].tolist()):
                now = max(now, us)
                span = spans.setdefault(i, [None, None])
                if kind == opens:
                    span[0] = us if span[0] is None else min(span[0], us)
                elif kind == closes:
                    span[1] = us if span[1] is None else max(span[1], us)
        status = lambda o, c: "UNMATCHED" if o is None else "CLOSED" if c is not None else "ORPHANED" if now - o > orphan_us else "OPEN"
        out = [(key[0], i, o, c, status(o, c)) for i, (o, c) in spans.items()]
        # closed spans are done; what is left is as much as a run has open at a time
        live = {i: x for i, x in spans.items() if x[0] is None or x[1] is None}
        state.update((list(live), [x[0] for x in live.values()], [x[1] for x in live.values()], now))
        yield pd.DataFrame(out, columns=["run_id", "span_id", "opened_us", "closed_us", "status"]).astype({"opened_us": "Int64", "closed_us": "Int64"})

    return stream.groupBy("run_id").applyInPandasWithState(
        update, "run_id long, span_id long, opened_us long, closed_us long, status string", "ids array<long>, opened array<long>, closed array<long>, now long", "update", GroupStateTimeout.NoTimeout
    )


def quarantine(stream: DataFrame, key: str = "source", retries: int = 2) -> DataFrame:
    """(key, state, retries): the state machine of each item. A failure makes it QUARANTINED; a retry RETRIED; from there a success
    leads to RELEASED and a failure back to QUARANTINED, or, after ``retries`` retries, to TERMINAL, which is final. Other events
    change nothing. Events are taken in the order of (us, event_id) within each batch.

    ``stream`` has the key, kind ('ok', 'fail' or 'retry'), us and event_id."""

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else ("NEW", 0)
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        for kind in rows["kind"]:
            if kind == "fail" and now in ("NEW", "RELEASED", "RETRIED"):
                now, n = ("TERMINAL", n) if now == "RETRIED" and n >= retries else ("QUARANTINED", n if now == "RETRIED" else 0)
            elif kind == "retry" and now == "QUARANTINED":
                now, n = "RETRIED", n + 1
            elif kind == "ok" and now == "RETRIED":
                now = "RELEASED"
        state.update((now, n))
        yield pd.DataFrame({key: [group[0]], "state": [now], "retries": [n]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, state string, retries int", "state string, retries int", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append") -> tuple[DataFrame, int]:
    """All that ``stream`` holds now, by a query that ends there, as a table in the shared folder, and how many events were left
    out as too late. Each batch replaces nothing, so updates of one key come as several rows with their batch."""
    spark = stream.sparkSession
    base = f"{kept(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/n={n}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).start()
    q.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    return spark.read.parquet(f"{base}/out"), late


def _latest(df: DataFrame, keys: list[str]) -> DataFrame:
    cols = [c for c in df.columns if c not in ("batch", *keys)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("_r")).select(*keys, "_r.*")


def tumbling_counts(spark: SparkSession, path: str, **window: str) -> DataFrame:
    out, _ = drain(hourly(read_events(spark, path), **window).withColumnRenamed("n", "events"), "update")
    return _latest(out.drop("n"), ["start_us", "event_type"]).withColumnRenamed("events", "n")


def distinct_events(spark: SparkSession, path: str) -> DataFrame:
    out, _ = drain(without_repeats(read_events(spark, path)).select("event_id"))
    return out.agg(F.count(F.lit(1)).alias("n"))


def last_state(spark: SparkSession, path: str) -> DataFrame:
    out, _ = drain(span_states(read_events(spark, path)), "update")
    return _latest(out.drop("n"), ["user_id"]).select("user_id", "events", "last_type", "last_us")


def session_counts(spark: SparkSession, path: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions grow and merge as events arrive, so they are given out whole at the end."""
    out, _ = drain(sessions(read_events(spark, path), gap).withColumnRenamed("n", "events"), "complete")
    last = out.agg(F.max("batch").alias("last"))
    return out.join(F.broadcast(last), F.col("batch") == F.col("last")).select("user_id", "start_us", "end_us", F.col("events").alias("n"))


def span_lives(spark: SparkSession, path: str, orphan_us: int = 6 * 3_600_000_000) -> DataFrame:
    """Views open a span of a user's run, purchases close the one that the user opened last."""
    kinds = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "purchase", "close")
    rows = read_events(spark, path).select(F.col("user_id").alias("run_id"), F.floor(F.unix_micros("at") / 86_400_000_000).cast("long").alias("span_id"), kinds.alias("kind"), F.unix_micros("at").alias("us"))
    out, _ = drain(span_life(rows.where("kind is not null"), orphan_us), "update")
    return _latest(out.drop("n"), ["run_id", "span_id"])


def quarantined(spark: SparkSession, path: str, retries: int = 2) -> DataFrame:
    """Users as items: errors are failures, clicks retries, purchases successes."""
    kinds = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "retry").when(F.col("event_type") == "purchase", "ok")
    rows = read_events(spark, path).select(F.col("user_id").alias("source"), kinds.alias("kind"), F.unix_micros("at").alias("us"), "event_id")
    out, _ = drain(quarantine(rows.where("kind is not null"), "source", retries), "update")
    return _latest(out.drop("n"), ["source"])
