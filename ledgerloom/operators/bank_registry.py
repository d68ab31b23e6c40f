"""Names and routing codes against a registry: code prefixes from long to short, then names from exact to contained."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a name that tell nothing of which institution it is.
LEGAL = r"\b(the|limited|ltd|pvt|private|co|inc)\b"


def plain_name(c: Column) -> Column:
    """A name in small letters, without punctuation."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def normal_name(c: Column) -> Column:
    """... and without words of legal form, ``co operative`` written as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain_name(c), "co operative", "cooperative"), LEGAL, ""), " +", " "))


def observed_prefixes(rows: DataFrame, names: DataFrame, code: str, name: str, sizes: Sequence[int] = (10, 8, 6, 4)) -> DataFrame:
    """(size, prefix, bank_id): the institution that rows with an exact name show for each prefix of their code, the most frequent
    one, and the smallest id on ties."""
    known = rows.withColumn("_k", plain_name(F.col(name))).where(F.col(code).isNotNull()).join(names, "_k")
    each = known.select(F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.substring(F.upper(F.trim(F.col(code))), 1, n).alias("prefix")) for n in sizes])).alias("p"), "bank_id")
    counts = each.select("p.*", "bank_id").where(F.length("prefix") == F.col("size")).groupBy("size", "prefix", "bank_id").count()
    return counts.groupBy("size", "prefix").agg(F.max_by("bank_id", F.struct("count", -F.col("bank_id"))).alias("bank_id"))


def resolve(rows: DataFrame, catalogue: DataFrame, id: str, name: str, code: str, sizes: Sequence[int] = (10, 8, 6, 4), max_entries: int = 100_000) -> DataFrame:
    """(id, bank_id, how): by the longest known prefix of the code, else the exact name, else the normal name, else the longest
    normal name contained in it; null where none fits. The catalogue goes to every task, so its size is checked first."""
    entries = catalogue.select(F.col("bank_id"), F.col("bank_name")).where("bank_id is not null and bank_name is not null")
    if entries.limit(max_entries + 1).count() > max_entries:
        raise ValueError(f"the registry has more than {max_entries} entries")
    exact = entries.groupBy(plain_name(F.col("bank_name")).alias("_k")).agg(F.min("bank_id").alias("bank_id"))
    normal = entries.groupBy(normal_name(F.col("bank_name")).alias("_n")).agg(F.min("bank_id").alias("by_normal")).where("_n <> ''")
    prefixes = observed_prefixes(rows, exact, code, name, sizes)
    x = rows.select(F.col(id).alias("id"), plain_name(F.col(name)).alias("_k"), normal_name(F.col(name)).alias("_n"), F.upper(F.trim(F.col(code))).alias("_c"))
    for n in sizes:
        of = prefixes.where(F.col("size") == n).select(F.col("prefix").alias(f"_p{n}"), F.col("bank_id").alias(f"by_{n}"))
        x = x.withColumn(f"_p{n}", F.when(F.length("_c") >= n, F.substring("_c", 1, n))).join(of, f"_p{n}", "left")
    x = x.join(F.broadcast(exact.withColumnRenamed("bank_id", "by_name")), "_k", "left").join(F.broadcast(normal), "_n", "left")
    found = F.coalesce(*[F.col(f"by_{n}") for n in sizes], "by_name", "by_normal")
    how = F.coalesce(*[F.when(F.col(f"by_{n}").isNotNull(), f"CODE_{n}") for n in sizes], F.when(F.col("by_name").isNotNull(), "NAME"), F.when(F.col("by_normal").isNotNull(), "NORMAL_NAME"))
    x = x.select("id", "_n", found.alias("bank_id"), how.alias("how"))
    # names that hold the name of an entry: distinct ones, against the registry as one array
    open_names = x.where("bank_id is null and _n <> ''").select("_n").distinct()
    listed = normal.agg(F.array_sort(F.collect_list(F.struct((-F.length("_n")).alias("l"), F.col("_n").alias("n"), "by_normal"))).alias("all"))
    hits = open_names.crossJoin(F.broadcast(listed)).select("_n", F.get(F.filter("all", lambda e: F.concat(F.lit(" "), F.col("_n"), F.lit(" ")).contains(F.concat(F.lit(" "), e["n"], F.lit(" ")))), F.lit(0))["by_normal"].alias("by_part"))
    x = x.join(hits.where("by_part is not null"), "_n", "left")
    return x.select(F.col("id").alias(id), F.coalesce("bank_id", "by_part").alias("bank_id"), F.coalesce("how", F.when(F.col("by_part").isNotNull(), "CONTAINED")).alias("how"))
