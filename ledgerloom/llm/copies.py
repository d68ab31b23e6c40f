"""Records that differ only in formatting, kept once with their exact number of copies.

Canonical records are range-partitioned and sorted externally, then runs of adjacent rows are scanned and their full
keys compared. The row id is the last range key, so a key that holds a third of all rows is spread over many
partitions; the runs a partition boundary cuts are stitched together afterwards from a table of at most two runs a
partition.

Two rows are copies if account, date and balance agree without case, whitespace and punctuation (sign and decimal point
of the balance count) and their descriptions agree either as one string of letters and digits or as a multiset of
segments; being a copy carries over from row to row.

Defined results: null agrees with null only, and differs from blank. Exact repeats are copies. An empty table gives no
rows. Rows without id are left out, as they can't be named. Other columns of the input, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import written

#: Marks a null field, so that it differs from a blank one.
NULL = "\u0000"
_DROP = r"[^\p{L}\p{M}\p{N}]+"
#: What separates the segments of a description; a comma or a lone dot does so only where nothing else does.
_HARD = r"[|;/:_\-‐-―]"
_SOFT = r",|\s\.\s"

_SCAN = "kind int, first_id long, copy_id long, sig long, acct string, day string, bal string, k1 string, k2 string"


def squeeze(c: Column) -> Column:
    """Letters, marks and digits of ``c`` in lower case; null stays apart from blank."""
    return F.coalesce(F.regexp_replace(F.lower(c), _DROP, ""), F.lit(NULL))


def balance_key(c: Column) -> Column:
    """``c`` with nothing but sign, digits, letters and decimal points."""
    minus = F.regexp_replace(F.lower(c), "[−‐-―]", "-")
    return F.coalesce(F.regexp_replace(minus, r"[^\p{L}\p{N}.\-]+", ""), F.lit(NULL))


def segments_key(c: Column) -> Column:
    """The segments of ``c``, squeezed and sorted."""
    parts = F.when(c.rlike(_HARD), F.split(c, _HARD)).otherwise(F.split(c, _SOFT))
    clean = F.filter(F.transform(parts, lambda p: F.regexp_replace(F.lower(p), _DROP, "")), lambda p: p != "")
    return F.coalesce(F.array_join(F.array_sort(clean), "\u0001"), F.lit(NULL))


def canonical(df: DataFrame, id: str, account: str, date: str, description: str, balance: str) -> DataFrame:
    """``df`` as canonical records: id, comparison keys, and ``sig``, equal for all rows that could be copies."""
    k1 = squeeze(F.col(description))
    keyed = df.select(
        F.col(id).cast("long").alias("id"),
        F.coalesce(F.col(account).cast("string"), F.lit(NULL)).alias("acct"),
        squeeze(F.col(date).cast("string")).alias("day"),
        balance_key(F.col(balance).cast("string")).alias("bal"),
        k1.alias("k1"),
        segments_key(F.col(description)).alias("k2"),
    ).where(F.col("id").isNotNull())
    # the letters of a description in sorted order survive any order of its segments and any punctuation
    return keyed.withColumn("sig", F.xxhash64("acct", "day", "bal", F.array_sort(F.split("k1", ""))))


class _Run:
    """Rows of one (sig, account, date, balance), ids ascending."""

    def __init__(self, key: tuple) -> None:
        self.key, self.ids, self.variants = key, [], []
        self.slot: dict[tuple[str, str], int] = {}
        self.pairs: list[tuple[str, str]] = []

    def add(self, ids: list[int], k1: list[str], k2: list[str]) -> None:
        for i, pair in zip(ids, zip(k1, k2)):
            s = self.slot.setdefault(pair, len(self.pairs))
            if s == len(self.pairs):
                self.pairs.append(pair)
            self.ids.append(i)
            self.variants.append(s)

    def firsts(self) -> np.ndarray:
        """For each variant, the smallest id of its component."""
        parent = components(self.pairs)
        root = np.asarray(parent)[np.asarray(self.variants)]
        low = np.full(len(self.pairs), np.iinfo(np.int64).max, np.int64)
        np.minimum.at(low, root, np.asarray(self.ids, np.int64))
        return low[np.asarray(parent)]


def components(pairs: list[tuple[str, str]]) -> list[int]:
    """For each (k1, k2), the root of the component in which equal k1 or equal k2 join pairs."""
    parent = list(range(len(pairs)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen: dict[tuple[int, str], int] = {}
    for i, pair in enumerate(pairs):
        for side, key in enumerate(pair):
            j = seen.setdefault((side, key), i)
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(pairs))]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local pairs (kind 0) of every run; the variants (kind 1) of the runs at either end of the partition."""
    names = [x.split()[0] for x in _SCAN.split(", ")]
    types = [pa.int32(), *[pa.int64()] * 3, *[pa.string()] * 5]
    run: _Run | None = None
    count = 0

    def close(run: _Run, edge: bool) -> Iterator[pa.RecordBatch]:
        low = run.firsts()
        first, ids = low[np.asarray(run.variants)], np.asarray(run.ids, np.int64)
        more = first != ids
        if more.any():
            n = int(more.sum())
            cols = [pa.array(np.zeros(n, np.int32)), pa.array(first[more]), pa.array(ids[more])] + [pa.nulls(n, t) for t in types[3:]]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        if edge:
            n, (sig, acct, day, bal) = len(run.pairs), run.key
            cols = [[1] * n, low.tolist(), [None] * n, [sig] * n, [acct] * n, [day] * n, [bal] * n, [p[0] for p in run.pairs], [p[1] for p in run.pairs]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        sig = batch.column("sig").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(sig[1:] != sig[:-1]) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(sig)]))
        last = len(starts) - 1
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            if b - a == 1 and 0 < k < last:
                # a single row inside the batch: it ends the run before it and starts none
                if run is not None:
                    yield from close(run, count == 0)
                    run, count = None, count + 1
                count += 1
                continue
            part = batch.slice(a, b - a)
            cols = {n: part.column(n).to_pylist() for n in ("id", "sig", "acct", "day", "bal", "k1", "k2")}
            for i in range(b - a):
                key = (cols["sig"][i], cols["acct"][i], cols["day"][i], cols["bal"][i])
                if run is None or run.key != key:
                    if run is not None:
                        yield from close(run, count == 0)
                        count += 1
                    run = _Run(key)
                run.add([cols["id"][i]], [cols["k1"][i]], [cols["k2"][i]])
    if run is not None:
        yield from close(run, True)


def find_copies(
    df: DataFrame,
    id: str = "transaction_id",
    account: str = "account_key",
    date: str = "transaction_date",
    description: str = "description",
    balance: str = "balance",
) -> DataFrame:
    """(first_id, copy_id): one row for each further copy, ``first_id`` being the smallest id of its group."""
    keys = ["sig", "acct", "day", "bal", "id"]
    records = canonical(df, id, account, date, description, balance)
    ordered = records.repartitionByRange(*keys).sortWithinPartitions(*keys)
    scan = written(ordered.mapInArrow(_scan, _SCAN))
    local = scan.where("kind = 0").select("first_id", "copy_id")
    edges = scan.where("kind = 1")

    def stitch(rows):
        parent = components(list(zip(rows.k1, rows.k2)))
        # equal local firsts were one component within their partition already
        by_first: dict[int, int] = {}
        low: dict[int, int] = {}
        join = list(range(len(rows)))

        def find(x: int) -> int:
            while join[x] != x:
                join[x] = join[join[x]]
                x = join[x]
            return x

        for i, (root, first) in enumerate(zip(parent, rows.first_id)):
            for j in (root, by_first.setdefault(first, i)):
                a, b = find(i), find(j)
                join[max(a, b)] = min(a, b)
        for i, first in enumerate(rows.first_id):
            low[find(i)] = min(first, low.get(find(i), first))
        out = rows[["first_id"]].rename(columns={"first_id": "local_first"})
        out["first_of_all"] = [low[find(i)] for i in range(len(rows))]
        return out[out.local_first != out.first_of_all].drop_duplicates()

    moved = written(edges.groupBy("sig", "acct", "day", "bal").applyInPandas(stitch, "local_first long, first_of_all long"))
    whole = local.join(moved, local.first_id == moved.local_first, "left").select(
        F.coalesce("first_of_all", "first_id").alias("first_id"), "copy_id"
    )
    return whole.unionByName(moved.select(F.col("first_of_all").alias("first_id"), F.col("local_first").alias("copy_id")))


def collapse_copies(df: DataFrame, id: str = "transaction_id", **columns: str) -> DataFrame:
    """``df`` with one representative of each group of copies and ``n_copies``, the exact size of its group."""
    pairs = written(find_copies(df, id, **columns))
    counts = pairs.groupBy("first_id").agg((F.count(F.lit(1)) + 1).alias("_n"))
    kept = df.join(pairs.select(F.col("copy_id").alias(id)), id, "left_anti")
    joined = kept.join(counts, kept[id] == counts["first_id"], "left").drop("first_id")
    return joined.withColumn("n_copies", F.coalesce("_n", F.lit(1))).drop("_n")
