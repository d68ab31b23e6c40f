"""The queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import catalog, copies, encoding, language, mixing, packing, pii, reading
from ledgerloom.session import table


def p1_labelled(spark: SparkSession, d: str) -> DataFrame:
    """Each document, or each line of a mixed one, and each translation's source with its language and confidence."""
    docs = language.label_texts(table(spark, d, "documents"), "doc_id", "text", "lang").withColumn("record_kind", F.lit("document"))
    sources = language.label_texts(table(spark, d, "translations"), "result_id", "source_text", "source_language", segments=False)
    return docs.unionByName(sources.withColumn("record_kind", F.lit("translation"))).withColumnRenamed("id", "record_id")


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every line of every document, as decoded."""
    return language.label_segments(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.col("label_code").isNull() | (F.col("label_code") != F.col("lang"))
    return p1_labelled(spark, d).where((F.col("line_no") >= 0) | wrong).select("record_kind", "record_id", "line_no", "lang")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every damaged record with the chains it went through and its text restored."""
    of = lambda kind, name, id: encoding.find_damage(table(spark, d, name), id, "text").withColumn("record_kind", F.lit(kind))
    both = of("document", "documents", "doc_id").unionByName(of("span", "text_spans", "span_id"))
    return both.withColumnRenamed("id", "record_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_restored(spark, d).select("record_kind", "record_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return catalog.map_names(table(spark, d, "detections"), table(spark, d, "banks_catalog"))


def p4_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All entries within the limit of each name."""
    return catalog.candidates(table(spark, d, "detections"), table(spark, d, "banks_catalog"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.find_copies(table(spark, d, "transactions"))


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse_copies(table(spark, d, "transactions"))


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with personal data: what was found, and its text with placeholders."""
    return pii.find_pii(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = p7_redacted(spark, d).select("doc_id", F.explode(F.array_distinct(F.transform("found", lambda x: F.struct(x["pii_type"].alias("pii_type"), x["pii_text"].alias("pii_text"))))).alias("x"))
    return found.select("doc_id", "x.pii_type", "x.pii_text")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The chosen records with their repeats, each with the share that its source reaches."""
    chosen, shares = mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))
    return chosen.join(F.broadcast(shares.select("source", "target_share", "actual_share")), "source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.assign_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select(F.col("id").alias("doc_id"), "level")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_labelled, p1_segments, p2_found, p2_restored, p4_found, p4_candidates, p6_found, p6_collapsed, p7_found, p7_redacted, p8_packed, p9_mixed, p9_shares, p10_found,
    )
}
_STRIP = r"regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"
_HARD = r"'[|;/:_\-\x{2010}-\x{2015}]'"
#: Labels go back and forth between equal letters and equal segments until they stand still.
_COPIES = (
    "WITH k AS (SELECT transaction_id AS id, account_key AS a, " + _STRIP.format("transaction_date") + r""" AS d, regexp_replace(regexp_replace(lower(balance), '[\x{2212}\x{2010}-\x{2015}]', '-', 'g'), '[^\p{L}\p{N}.\-]+', '', 'g') AS b,
  """ + _STRIP.format("description") + " AS k1, array_to_string(list_sort(list_filter(list_transform(CASE WHEN regexp_matches(description, " + _HARD + ") THEN regexp_split_to_array(description, " + _HARD + r""") ELSE regexp_split_to_array(description, ',|\s\.\s') END,
  lambda x: """ + _STRIP.format("x") + "), lambda x: x <> '')), chr(1)) AS k2 FROM transactions)"
    + "".join(f", m{i} AS (SELECT *, min({'id' if i == 1 else f'l{i - 1}'}) OVER (PARTITION BY a, d, b, {'k1' if i % 2 else 'k2'}) AS l{i} FROM {'k' if i == 1 else f'm{i - 1}'})" for i in range(1, 8))
)
SQL: dict[str, str] = {
    "p6_found": _COPIES + " SELECT l7 AS first_id, id AS copy_id FROM m7 WHERE l7 <> id",
    "p6_collapsed": _COPIES + ", n AS (SELECT l7, count(*) AS n FROM m7 GROUP BY 1) SELECT t.*, n AS n_copies FROM transactions t JOIN n ON t.transaction_id = n.l7",
}
