"""Statutory identifiers in texts, with roles, repairs and a document type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import identifiers as ids

BUYER, SUPPLIER = r"(?i)\b(buyer|bill(ed)? to|recipient|customer|consignee)\b", r"(?i)\b(supplier|seller|vendor|sold by|from|consignor|provider)\b"


def repair_gstin(c: Column) -> Column:
    """Misread characters put right by position; the check digit is never made up."""
    x = F.upper(F.regexp_replace(c, r"[\s\-]", ""))
    digits, letters = (lambda y: F.translate(y, *ids.TAX_DIGIT)), (lambda y: F.translate(y, *ids.TO_LETTER))
    fixed = F.concat(digits(F.substring(x, 1, 2)), letters(F.substring(x, 3, 5)), digits(F.substring(x, 8, 4)), letters(F.substring(x, 12, 1)), F.substring(x, 13, 1), F.when(F.substring(x, 14, 1) == "2", "Z").otherwise(F.substring(x, 14, 1)), F.substring(x, 15, 1))
    return F.when((F.length(x) == 15) & ids.verify_gstin(fixed), fixed).otherwise(x)


def extract(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, kind, value, first_at): distinct identifiers of each text. Order of kinds: IRN, CIN, CNR, GSTIN, PAN, TAN, DIN;
    repaired GSTIN and PAN count if they are valid then, a DIN only next to its label."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"\b([A-Za-z0-9][A-Za-z0-9-]{7,63})\b"), F.lit(1))
    x = df.select(F.col(id).alias("id"), F.col(text).alias("t"), F.posexplode(words).alias("pos", "w"))
    x = x.withColumn("w", F.upper(F.regexp_replace("w", "-", ""))).where(F.length("w").isin(8, 10, 15, 16, 21, 64) & F.col("w").rlike("[0-9]"))
    w, n = F.col("w"), F.length("w")
    gst, pan = repair_gstin(w), ids.repair_pan(w)
    din = ids.verify_din(w) & F.col("t").rlike("(?i)din|director")
    kind = (
        F.when((n == 64) & w.rlike("^[0-9A-F]{64}$"), "IRN").when((n == 21) & ids.verify_cin(w), "CIN").when((n == 16) & ids.verify_cnr(w), "CNR").when((n == 15) & ids.verify_gstin(gst), "GSTIN")
        .when((n == 10) & ids.verify_pan(w), "PAN").when((n == 10) & ids.verify_tan(w), "TAN").when((n == 10) & ids.verify_pan(pan), "PAN").when((n == 8) & din, "DIN")
    )
    x = x.withColumn("kind", kind).where("kind is not null")
    value = F.when(F.col("kind") == "GSTIN", gst).when(F.col("kind") == "PAN", F.when(ids.verify_pan(w), w).otherwise(pan)).otherwise(w)
    return x.groupBy("id", "kind", value.alias("value")).agg(F.min("pos").alias("first_at")).withColumnRenamed("id", id)


def roles(df: DataFrame, id: str, text: str, found: DataFrame) -> DataFrame:
    """(id, value, role): supplier or buyer by the nearest such word in the 150 characters before each GSTIN."""
    g = found.where("kind = 'GSTIN'").select(id, "value").join(df.select(id, F.col(text).alias("t")), id)
    at = F.instr(F.upper("t"), F.col("value"))
    before = F.substr("t", F.greatest(F.lit(1), at - 150), F.least(at - 1, F.lit(150)))
    last = lambda p: F.length(F.regexp_extract(F.col("b"), f"^(.*){p}", 1))
    x = g.withColumn("b", F.when(at > 1, F.regexp_replace(before, r"\n", " ")).otherwise(""))
    has = lambda p: F.col("b").rlike(p)
    flat = lambda p: p.replace("(?i)", "")
    buyer = F.when(has(BUYER), last("(?i)" + flat(BUYER))).otherwise(-1)
    supplier = F.when(has(SUPPLIER), last("(?i)" + flat(SUPPLIER))).otherwise(-1)
    return x.select(id, "value", F.when(buyer > supplier, "buyer").when(supplier > buyer, "supplier").alias("role"))


def as_json(found: DataFrame, id: str) -> DataFrame:
    """(id, json): all identifiers of a text by kind, in order of first sight."""
    item = F.struct("first_at", "value")
    by = found.groupBy(id, "kind").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["value"]).alias("values"))
    return by.groupBy(id).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "values"))))).alias("json"))
