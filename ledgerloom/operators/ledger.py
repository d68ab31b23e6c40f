"""Ledger analytics: running balances, direction and order of rows, periods, roll-ups, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import written

TOLERANCE = 0.01


def _net(debit: str, credit: str) -> Column:
    return F.coalesce(F.col(credit), F.lit(0)) - F.coalesce(F.col(debit), F.lit(0))


def _cumulated(df: DataFrame, keys: Sequence[str], seq: str, debit: str, credit: str, balance: str, block: int) -> DataFrame:
    """``df`` with ``_c``, the movements of the group up to each row, and ``_a``, the group's last own balance less its own
    ``_c`` before the row's block. Rows are summed within blocks of ``seq``, blocks beside each other, so that a group of any
    size is spread over many tasks; the table of blocks has a row per group and block."""
    x = df.withColumn("_blk", F.floor(F.col(seq) / block)).withColumn("_net", _net(debit, credit))
    inside = Window.partitionBy(*keys, "_blk").orderBy(seq)
    x = x.withColumn("_in", F.sum("_net").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = F.when(F.col(balance).isNotNull(), F.struct(F.col(seq).alias("s"), (F.col(balance) - F.col("_in")).alias("a")))
    blocks = x.groupBy(*keys, "_blk").agg(F.sum("_net").alias("_t"), F.max(own)["a"].alias("_own"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    blocks = blocks.withColumn("_a", F.last(F.col("_own") - F.col("_before"), ignorenulls=True).over(before)).select(*keys, "_blk", "_before", "_a")
    same = [x[k].eqNullSafe(blocks[k]) for k in (*keys, "_blk")]
    joined = x.join(blocks, same).drop(*[blocks[k] for k in (*keys, "_blk")])
    return joined.withColumn("_c", F.col("_before") + F.col("_in")).drop("_in", "_before", "_net")


def running_balance_check(df: DataFrame, keys: Sequence[str], seq: str, debit: str, credit: str, balance: str, opening: str | None = None, block: int = 1_000_000) -> DataFrame:
    """``df`` with ``expected`` and ``discontinuity``: own balances are checked against the last own balance before them (else
    the opening) plus the movements since. ``seq`` is a number; ``block`` is how much of it one task sorts at most."""
    x = _cumulated(df, keys, seq, debit, credit, balance, block)
    before = Window.partitionBy(*keys, "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    # a balance less the movements up to it stays the same until the next own balance
    anchor = F.coalesce(F.last(F.col(balance) - F.col("_c"), ignorenulls=True).over(before), "_a", *([opening] if opening else []))
    x = x.withColumn("expected", anchor + F.col("_c"))
    bad = F.col(balance).isNotNull() & F.col("expected").isNotNull() & (F.abs(F.col(balance) - F.col("expected")) >= TOLERANCE)
    return x.withColumn("discontinuity", F.coalesce(bad, F.lit(False))).drop("_blk", "_a", "_c")


def beside(df: DataFrame, keys: Sequence[str], seq: str, columns: Sequence[str], block: int = 1_000_000) -> DataFrame:
    """``df`` with ``_prev`` and ``_next``, structs of ``columns`` of the rows before and after in the order of ``seq``. Rows are
    sorted within blocks of ``seq``; the ends of blocks meet in a table with a row per group and block."""
    row = F.struct(*columns)
    x = df.withColumn("_blk", F.floor(F.col(seq) / block))
    inside = Window.partitionBy(*keys, "_blk").orderBy(seq)
    x = x.withColumn("_prev", F.lag(row).over(inside)).withColumn("_next", F.lead(row).over(inside))
    ends = x.groupBy(*keys, "_blk").agg(F.min_by(row, seq).alias("_head"), F.max_by(row, seq).alias("_tail"))
    blocks = Window.partitionBy(*keys).orderBy("_blk")
    ends = ends.select(*keys, "_blk", F.lag("_tail").over(blocks).alias("_before"), F.lead("_head").over(blocks).alias("_after"))
    joined = x.join(ends, [x[k].eqNullSafe(ends[k]) for k in (*keys, "_blk")]).drop(*[ends[k] for k in (*keys, "_blk")])
    return joined.withColumn("_prev", F.coalesce("_prev", "_before")).withColumn("_next", F.coalesce("_next", "_after")).drop("_blk", "_before", "_after")


def counted(df: DataFrame, keys: Sequence[str], seq: str, flag: Column, name: str, block: int = 1_000_000) -> DataFrame:
    """``df`` with ``name``, how many rows up to each one have ``flag``, and ``{name}_all``, how many of the group; by blocks."""
    x = df.withColumn("_blk", F.floor(F.col(seq) / block)).withColumn("_one", F.when(flag, 1).otherwise(0))
    inside = Window.partitionBy(*keys, "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_in", F.sum("_one").over(inside))
    sums = x.groupBy(*keys, "_blk").agg(F.sum("_one").alias("_n"))
    of_key = Window.partitionBy(*keys)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(of_key.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(f"{name}_all", F.sum("_n").over(of_key)).drop("_n")
    joined = x.join(sums, [x[k].eqNullSafe(sums[k]) for k in (*keys, "_blk")]).drop(*[sums[k] for k in (*keys, "_blk")])
    return joined.withColumn(name, F.col("_in") + F.col("_base")).drop("_blk", "_one", "_in", "_base")


def carried(df: DataFrame, keys: Sequence[str], seq: str, value: Column, name: str, block: int = 1_000_000) -> DataFrame:
    """``df`` with ``name``, the last ``value`` that isn't null up to each row; by blocks."""
    x = df.withColumn("_blk", F.floor(F.col(seq) / block)).withColumn("_v", value)
    upto = Window.partitionBy(*keys, "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_in", F.last("_v", ignorenulls=True).over(upto))
    ends = x.groupBy(*keys, "_blk").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(seq))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_blk", F.last("_end", ignorenulls=True).over(before).alias("_from"))
    joined = x.join(ends, [x[k].eqNullSafe(ends[k]) for k in (*keys, "_blk")]).drop(*[ends[k] for k in (*keys, "_blk")])
    return joined.withColumn(name, F.coalesce("_in", "_from")).drop("_blk", "_v", "_in", "_from")


def repeated_daily_balance(df: DataFrame, keys: Sequence[str], seq: str, day: str, balance: str) -> DataFrame:
    """``df`` with ``exempt``: the next row has the same day and balance."""
    x = beside(df, keys, seq, [day, balance])
    same = (F.col("_next")[day] == F.col(day)) & (F.abs(F.col("_next")[balance] - F.col(balance)) < TOLERANCE)
    return x.withColumn("exempt", F.coalesce(same, F.lit(False))).drop("_prev", "_next")


def backward_anchor(df: DataFrame, keys: Sequence[str], seq: str, debit: str, credit: str, balance: str, block: int = 1_000_000) -> DataFrame:
    """``df`` with ``expected_back``: the balance that the last row of the group implies for each row."""
    x = _cumulated(df, keys, seq, debit, credit, balance, block)
    ends = df.groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias("s"), F.col(balance).alias("b")))["b"].alias("_closing"), F.sum(_net(debit, credit)).alias("_total"))
    x = x.join(ends, [x[k].eqNullSafe(ends[k]) for k in keys]).drop(*[ends[k] for k in keys])
    return x.withColumn("expected_back", F.col("_closing") - F.col("_total") + F.col("_c")).drop("_blk", "_a", "_c", "_closing", "_total")


def order_and_inversion(df: DataFrame, keys: Sequence[str], seq: str, day: str, debit: str, credit: str, balance: str) -> DataFrame:
    """Per group: how many neighbours chain forwards, backwards and with debit and credit swapped; ``reversed`` and
    ``inverted`` verdicts (ties on order go to strictly falling days; inversion needs two, a majority, and three quarters)."""
    prev, nxt, net, before = F.col("_prev")[balance], F.col("_next")[balance], _net(debit, credit), F.col("_prev")[day]
    x = beside(df, keys, seq, [day, balance]).select(
        *keys,
        (F.col(balance) == prev + net).alias("f"),
        (F.col(balance) == nxt + net).alias("r"),
        ((F.col(balance) == prev - net) & (net != 0)).alias("i"),
        ((prev.isNotNull()) & (net != 0)).alias("t"),
        (F.col(day) < before).alias("falls"),
        (F.col(day) > before).alias("rises"),
    )
    n = lambda c: F.count_if(F.col(c))
    got = x.groupBy(*keys).agg(n("f").alias("forward"), n("r").alias("backward"), n("i").alias("swapped"), n("t").alias("testable"), n("falls").alias("falling"), n("rises").alias("rising"))
    return got.withColumn(
        "reversed", (F.col("backward") > F.col("forward")) | ((F.col("backward") == F.col("forward")) & (F.col("falling") > 0) & (F.col("rising") == 0))
    ).withColumn(
        "inverted", (F.col("testable") >= 2) & (F.col("swapped") >= 2) & (F.col("swapped") > F.col("forward")) & (F.col("swapped") >= 0.75 * F.col("testable"))
    )


def reconcile(statements: DataFrame, lines: DataFrame, key: str, opening: str, closing: str, debit: str, credit: str) -> DataFrame:
    """Statements with ``inferred_opening``, ``inferred_closing`` (from whichever is missing) and ``mismatch``."""
    sums = lines.groupBy(key).agg(F.sum(F.coalesce(F.col(debit), F.lit(0))).alias("_d"), F.sum(F.coalesce(F.col(credit), F.lit(0))).alias("_c"), F.count(F.lit(1)).alias("n_rows"))
    x = statements.join(sums, key, "left")
    net = F.coalesce("_c", F.lit(0)) - F.coalesce("_d", F.lit(0))
    x = x.withColumn("inferred_opening", F.coalesce(F.col(opening), F.col(closing) - net)).withColumn("inferred_closing", F.coalesce(F.col(closing), F.col(opening) + net))
    bad = F.abs(F.col("inferred_opening") + net - F.col("inferred_closing")) >= TOLERANCE
    return x.withColumn("mismatch", F.coalesce(bad, F.lit(False))).withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).drop("_d", "_c")


def eod_balance(df: DataFrame, account: str, day: str, order: Sequence[str], balance: str) -> DataFrame:
    """(account, day, eod_balance): the balance of the last row of each day; partial maxima meet, nothing is sorted."""
    return df.where(F.col(balance).isNotNull()).groupBy(account, day).agg(F.max_by(balance, F.struct(*order)).alias("eod_balance"))


def statement_gaps(statements: DataFrame, account: str, start: str, end: str, opening: str, closing: str, id: str, most_days: int = 35) -> DataFrame:
    """(id, account, next_id, gap_days, issue): gaps of more than ``most_days`` between statements of an account, and closing
    balances that the next opening doesn't carry on, unless the periods overlap."""
    w = Window.partitionBy(account).orderBy(start, end, id)
    x = statements.select(
        F.col(id).alias("id"), F.col(account).alias("account"), F.col(end).alias("_end"), F.col(closing).alias("_closing"),
        F.lead(id).over(w).alias("next_id"), F.lead(start).over(w).alias("_start"), F.lead(opening).over(w).alias("_opening"),
    )
    gap = F.datediff("_start", "_end")
    x = x.withColumn("gap_days", gap).where("next_id is not null")
    issues = F.array_compact(
        F.array(
            F.when(F.col("gap_days") > most_days, "MISSING_STATEMENT_PERIOD"),
            F.when((F.col("gap_days") > 0) & (F.abs(F.col("_closing") - F.col("_opening")) >= TOLERANCE), "CROSS_STATEMENT_BALANCE_DISCONTINUITY"),
        )
    )
    return x.select("id", "account", "next_id", "gap_days", F.explode(issues).alias("issue"))


def totals_by_currency(df: DataFrame, currency: str, debit: str, credit: str, default: str = "INR") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(currency), F.lit(default)).alias("currency")).agg(
        F.sum(debit).alias("total_debit"), F.sum(credit).alias("total_credit"), F.count(F.lit(1)).alias("n")
    )


def renumber(df: DataFrame, order: Sequence[str], partitions: str, name: str = "number", prefix: str = "TXN-") -> DataFrame:
    """Global numbers in ``order``, whose first column is ``partitions``: rank within it plus the rows before it, so that no
    single task sorts everything. At most one row of offsets per value of ``partitions``."""
    counts = df.groupBy(partitions).count()
    before = Window.orderBy(partitions).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(partitions, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(partitions).orderBy(*order))
    x = df.withColumn("_nth", inner).join(offsets, partitions).withColumn("_n", F.col("_nth") + F.col("_before"))
    return x.withColumn(name, F.concat(F.lit(prefix), F.when(F.length(F.col("_n").cast("string")) < 4, F.lpad(F.col("_n").cast("string"), 4, "0")).otherwise(F.col("_n").cast("string")))).drop("_nth", "_before", "_n")


def sample_rows(df: DataFrame, keys: Sequence[str], seq: str, head: int = 3, middle: int = 2, tail: int = 3) -> DataFrame:
    """The first, last and evenly spaced rows of each group."""
    x = counted(df, keys, seq, F.lit(True), "_i").withColumnRenamed("_i_all", "_n")
    step = (F.col("_n") / (middle + 1)).cast("int")
    keep = (F.col("_i") <= head) | (F.col("_i") > F.col("_n") - tail)
    for k in range(1, middle + 1):
        keep = keep | (F.col("_i") == step * k)
    return x.where(keep).withColumnRenamed("_i", "row_no").drop("_n")


def continuation_merge(df: DataFrame, keys: Sequence[str], seq: str, kind: str, text: str) -> DataFrame:
    """(keys, seq, merged, n_parts) per transaction row: texts of the continuation rows after it are appended; continuation
    rows before the first transaction of a group are orphans, with seq null."""
    x = counted(df.where(F.col(kind).isin("TRANSACTION", "CONTINUATION")), keys, seq, F.col(kind) == "TRANSACTION", "_g")
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    return x.groupBy(*keys, "_g").agg(F.min(F.when(F.col(kind) == "TRANSACTION", F.col(seq))).alias(seq), parts.alias("p")).select(
        *keys, seq, F.array_join(F.transform("p", lambda q: q["t"]), " ").alias("merged"), F.size("p").alias("n_parts")
    )


def inherit_date(df: DataFrame, keys: Sequence[str], seq: str, day: str, raw: str) -> DataFrame:
    """``df`` with ``inherited``: blank or ditto dates take the last good one of the group, but not across a bad one."""
    blank = F.coalesce(F.trim(F.col(raw)).isin("", "--", '"', "do", "ditto"), F.lit(True))
    mark = F.when(~blank, F.struct(F.col(day).alias("d")))
    x = carried(df, keys, seq, mark, "_mark")
    return x.withColumn("inherited", F.coalesce(F.col(day), F.when(blank, F.col("_mark")["d"]))).drop("_mark")


def after_end_marker(df: DataFrame, keys: Sequence[str], seq: str, is_end: Column) -> DataFrame:
    """Rows up to and including the first end marker of each group."""
    ends = df.groupBy(*keys).agg(F.min(F.when(is_end, F.col(seq))).alias("_end"))
    x = df.join(ends, [df[k].eqNullSafe(ends[k]) for k in keys]).drop(*[ends[k] for k in keys])
    return x.where(F.col("_end").isNull() | (F.col(seq) <= F.col("_end"))).drop("_end")


def path_of(edges: list[tuple[int, int]]) -> list[int] | None:
    """The numbers of ``edges`` in an order in which each begins where the one before ends; None if there is none."""
    leaving: dict[int, list[int]] = {}
    balance: dict[int, int] = {}
    for i, (a, b) in reversed(list(enumerate(edges))):
        leaving.setdefault(a, []).append(i)
        balance[a] = balance.get(a, 0) + 1
        balance[b] = balance.get(b, 0) - 1
    starts = [v for v, n in balance.items() if n > 0]
    if len(starts) > 1 or starts and balance[starts[0]] > 1:
        return None
    stack: list[tuple[int, int | None]] = [(starts[0] if starts else edges[0][0], None)]
    out: list[int] = []
    while stack:
        at, by = stack[-1]
        if leaving.get(at):
            i = leaving[at].pop()
            stack.append((edges[i][1], i))
        else:
            stack.pop()
            if by is not None:
                out.append(by)
    return out[::-1] if len(out) == len(edges) else None


def intraday_reorder(df: DataFrame, keys: Sequence[str], seq: str, debit: str, credit: str, balance: str, most: int = 12) -> DataFrame:
    """(keys, seq, position): rows of each day in an order in which their balances chain. Up to ``most`` rows that is the first
    such order by depth-first search; above, a path that uses each row once, a row leading from the balance before it to its own
    (which exists, and is found, in a time linear in the rows). Days without such an order stay as they are. Only days that
    fail are handed over."""
    w = Window.partitionBy(*keys).orderBy(seq)
    net = _net(debit, credit)
    x = df.select(*keys, seq, F.col(balance).cast("double").alias("_b"), net.cast("double").alias("_m"), (F.col(balance) == F.lag(balance).over(w) + net).alias("_ok"))
    whole = Window.partitionBy(*keys)
    x = x.withColumn("_bad", F.count_if(~F.col("_ok")).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_nulls", F.count_if(F.col("_b").isNull()).over(whole))
    hard = (F.col("_bad") > 0) & (F.col("_nulls") == 0)
    easy = x.where(~hard).select(*keys, seq, F.row_number().over(w).cast("int").alias("position"))

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(seq).reset_index(drop=True)
        b, m, n = rows._b.round(2).tolist(), rows._m.round(2).tolist(), len(rows)

        def search(path: list[int], used: set[int]) -> list[int] | None:
            if len(path) == n:
                return path
            for j in range(n):
                if j not in used and (not path or abs(b[path[-1]] + m[j] - b[j]) < TOLERANCE):
                    got = search([*path, j], used | {j})
                    if got:
                        return got
            return None

        path = (search([], set()) if n <= most else path_of([(round(100 * (y - x)), round(100 * y)) for x, y in zip(m, b)])) or list(range(n))
        rows["position"] = [path.index(i) + 1 for i in range(n)]
        return rows[[*keys, seq, "position"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, seq).schema.fields) + ", position int"
    return easy.unionByName(x.where(hard).groupBy(*keys).applyInPandas(chain, schema))


def token_sorted(c: Column) -> Column:
    """The words of ``c`` in small letters, sorted."""
    return F.array_join(F.array_sort(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")), " ")


def similar_texts(texts: DataFrame, least: float = 0.8) -> DataFrame:
    """(block, a, b): texts of one block whose edit distance leaves at least ``least`` of the longer one, each pair both ways.
    Such texts share a run of two letters, or of four if they are longer than 15, so that only those are compared."""
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("t") - n + 1)), lambda i: F.substr("t", i, F.lit(n)))
    both = F.when(F.length("t") <= 15, grams(2)).when(F.length("t") <= 20, F.concat(grams(2), grams(4))).otherwise(grams(4))
    keyed = texts.where("t <> ''").select("block", "t", F.explode(F.array_distinct(both)).alias("g"))
    left, right = keyed.select("block", "g", F.col("t").alias("a")), keyed.select("block", "g", F.col("t").alias("b"))
    pairs = left.join(right, ["block", "g"]).where("a <> b and abs(length(a) - length(b)) <= 0.2 * greatest(length(a), length(b))").select("block", "a", "b").distinct()
    return pairs.where(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")) >= least)


def duplicate_transactions(df: DataFrame, id: str, block: Sequence[str], ref: str, balance: str, statement: str, seq: str, text: str, time: str | None = None, least: float = 0.8) -> DataFrame:
    """(id, of_id, verdict): rows of a block (account, day, amounts, currency) that repeat an earlier one. Two rows contradict
    each other if both have a time, reference or balance and these differ, or if they stand in one statement at different places
    without an equal reference. PROVEN: equal reference, or equal text and balance, in different statements or with a reference on
    one side only. PROBABLE: equal text, or, where neither has a reference, a similar one, without proof.

    ``of_id`` is the first earlier row that proves it, else the first that makes it probable. Rows without any of the block's
    day and amounts repeat nothing. Survivors aren't enriched: each row is compared with the rows as they came.

    No pairs are made within a block: every row offers itself under the keys by which a later row may find it (with its own
    reference, balance and time, or with "none" or "any" in their place), the first row of each key and the first of another
    statement are kept, and every row looks up the few keys that suit it. Only rows of blocks with several rows take part."""
    has_ref = F.coalesce(F.trim(F.col(ref)) != "", F.lit(False))
    place = F.concat_ws("|", F.col(statement).cast("string"), F.col(seq).cast("string"))
    x = df.select(
        F.col(id).alias("id"), F.xxhash64(*block).alias("block"), token_sorted(F.col(text)).alias("t"), F.when(has_ref, F.upper(F.trim(F.col(ref)))).alias("r"),
        F.col(balance).cast("string").alias("b"), (F.col(time) if time else F.lit(None)).cast("string").alias("m"), F.col(statement).cast("string").alias("s"), place.alias("p"),
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(block)],
    )
    keys = [f"_k{i}" for i in range(len(block))]
    several = x.groupBy("block", *keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    x = x.join(several, [x["block"] == several["block"], *[x[k].eqNullSafe(several[k]) for k in keys]], "left_semi").drop(*keys)
    x = written(x)

    # "=" own value, "0" none, "1" some, "*" any
    own = lambda c: F.concat(F.lit("="), F.col(c))
    wild = lambda c: F.array(F.coalesce(own(c), F.lit("0")), F.lit("*"))
    seek = lambda c: F.when(F.col(c).isNull(), F.array(F.lit("*"))).otherwise(F.array(own(c), F.lit("0")))
    offers = x.select("id", "s", "block", "t", F.explode(F.when(F.col("r").isNull(), F.array(F.lit("0"))).otherwise(F.array(F.lit("1"), own("r")))).alias("kr"), "b", "m", "p", "r")
    offers = offers.select("id", "s", "block", F.explode(F.when(F.col("kr").startswith("="), F.array(F.lit("ref"), F.lit("place"))).otherwise(F.array(F.lit("text"), F.lit("place")))).alias("way"), "t", "kr", "b", "m", "p")
    offers = offers.where("not (way = 'place' and kr like '=%')")
    offers = offers.withColumn("kb", F.explode(wild("b"))).withColumn("km", F.explode(wild("m")))
    with_key = lambda df: df.withColumn("key", F.xxhash64("block", "way", F.when(F.col("way") != "ref", F.col("t")), "kr", "kb", "km", F.when(F.col("way") == "place", F.col("p"))))
    offers = with_key(offers)
    first = offers.groupBy("key").agg(F.min(F.struct("id", "s")).alias("a"))
    other = offers.join(first, "key").where(~F.col("s").eqNullSafe(F.col("a.s"))).groupBy("key").agg(F.min("id").alias("other"))
    table = first.join(other, "key", "left").select("key", F.col("a.id").alias("first_id"), F.col("a.s").alias("first_s"), "other")

    same = x.withColumn("like", F.lit(True)).withColumn("was", F.col("t"))
    near = similar_texts(x.where("r is null").select("block", "t").distinct(), least)
    alike = x.where("r is null").join(near.select("block", F.col("a").alias("t"), F.col("b").alias("was")), ["block", "t"]).withColumn("like", F.lit(False))
    looks = same.unionByName(alike.select(*same.columns))
    kinds = F.when(F.col("r").isNotNull(), F.array(F.struct(F.lit("ref").alias("way"), own("r").alias("kr")), *[F.struct(F.lit(w).alias("way"), F.lit("0").alias("kr")) for w in ("text", "place")]))
    kinds = kinds.otherwise(F.array(*[F.struct(F.lit(w).alias("way"), F.lit(k).alias("kr")) for w in ("text", "place") for k in ("0", "1")]))
    looks = looks.withColumn("k", F.explode(kinds)).select("id", "s", "block", "like", F.col("was").alias("t"), "b", "m", "p", "r", "k.way", "k.kr").where("like or kr = '0'")
    looks = with_key(looks.withColumn("kb", F.explode(seek("b"))).withColumn("km", F.explode(seek("m"))))
    met = looks.join(table, "key")
    earlier = F.when((F.col("way") != "text") | ~F.col("first_s").eqNullSafe(F.col("s")), F.col("first_id")).otherwise(F.col("other"))
    one_ref = F.when(F.col("r").isNull(), F.col("kr") == "1").otherwise(F.col("kr") == "0")
    proof = (F.col("way") == "ref") | (F.col("like") & F.col("kb").startswith("=") & ((F.col("way") == "text") | one_ref))
    # a row without a balance looks for any, so equal balances have to be looked for by their own key
    met = met.withColumn("of", earlier).where(F.col("of") < F.col("id")).groupBy("id").agg(F.min(F.when(proof, F.col("of"))).alias("proven"), F.min("of").alias("any"))
    return met.select("id", F.coalesce("proven", "any").alias("of_id"), F.when(F.col("proven").isNotNull(), "PROVEN").otherwise("PROBABLE").alias("verdict"))


def processing_summary(statements: DataFrame, lines: DataFrame, duplicates: DataFrame, issues: DataFrame, key: str, line_id: str) -> DataFrame:
    """Per statement: rows scanned, kept, duplicate and failed, and its issues joined, or ALL_CLEAR."""
    scanned = lines.groupBy(key).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("ok")).alias("good"))
    dup = lines.join(duplicates.select(F.col("id").alias(line_id)), line_id).groupBy(key).agg(F.count(F.lit(1)).alias("duplicates"))
    said = issues.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("issue")), "; ").alias("issues"))
    x = statements.select(key).join(scanned, key, "left").join(dup, key, "left").join(said, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    kept = zero("good") - F.least(zero("duplicates"), zero("good"))
    return x.select(key, zero("scanned").alias("scanned"), kept.alias("success"), zero("duplicates").alias("duplicates"), F.greatest(F.lit(0), zero("scanned") - kept - zero("duplicates")).alias("failed"), F.coalesce("issues", F.lit("ALL_CLEAR")).alias("issues"))
