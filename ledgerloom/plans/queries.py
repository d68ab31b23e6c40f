"""The core's registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import schema_drift, timestamps
from ledgerloom.plans import document_queries, event_queries, ledger_queries, mapping_queries, more_queries, native_queries, text_queries
from ledgerloom.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise(table(spark, d, "statement_rows"), table(spark, d, "statements"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "column_mappings"), table(spark, d, "raw_records"))


def p5_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Alternatives of a type that appear in a column, however few cells they have."""
    return schema_drift.alternatives(table(spark, d, "column_mappings"), table(spark, d, "raw_records"))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.unify(table(spark, d, "column_mappings"), table(spark, d, "raw_records"))


MODULES = (ledger_queries, text_queries, event_queries, more_queries, document_queries, mapping_queries, native_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p5_found": p5_found, "p5_alternatives": p5_alternatives, "p5_unified": p5_unified}
_KEY = r"regexp_replace(lower(h), '[^\p{L}\p{M}\p{N}]+', '', 'g')"
SQL: dict[str, str] = {
    "p5_found": r"""WITH one AS (SELECT feed_id, file_id, column_index, period_start AS ps, source_header AS h, canonical_field AS cf, row_number() OVER (PARTITION BY file_id, column_index ORDER BY mapping_id) AS r FROM column_mappings),
c AS (SELECT *, """ + _KEY + r""" AS k FROM one WHERE r = 1),
sh AS (SELECT k, cf AS shown, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, cf DESC) AS r FROM c WHERE cf IS NOT NULL GROUP BY k, cf),
cells AS (SELECT file_id, unnest(range(len(cells))) AS column_index, trim(unnest(cells)) AS v FROM raw_records),
tag AS (SELECT file_id, column_index, CASE WHEN regexp_matches(v, '^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{2,3})+)$') THEN 'i' WHEN regexp_matches(v, '^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{2,3})+)\.[0-9]+$') THEN 'd'
  WHEN regexp_matches(v, '^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.]([0-9]{4}|[0-9]{2})|[0-9]{1,2}[- ]\p{L}{3,9}[- ,]+([0-9]{4}|[0-9]{2})|\p{L}{3,9} [0-9]{1,2},? [0-9]{4})$') THEN 't' ELSE 'x' END AS t FROM cells WHERE v <> ''),
ty AS (SELECT file_id, column_index, CASE WHEN bool_or(t = 'x') OR (bool_or(t = 't') AND bool_or(t IN ('i', 'd'))) THEN 'text' WHEN bool_or(t = 't') THEN 'date' WHEN bool_or(t = 'd') THEN 'decimal' ELSE 'integer' END AS ty FROM tag GROUP BY 1, 2),
x AS (SELECT c.feed_id, c.file_id, c.column_index, c.ps, c.h, c.k, coalesce(c.cf, sh.shown, c.k) AS f, ty.ty FROM c LEFT JOIN sh ON sh.k = c.k AND sh.r = 1 LEFT JOIN ty ON ty.file_id = c.file_id AND ty.column_index = c.column_index),
fl AS (SELECT feed_id, file_id, lag(file_id) OVER (PARTITION BY feed_id ORDER BY min(ps), file_id) AS prev FROM x GROUP BY feed_id, file_id),
o AS (SELECT fl.file_id AS fid, x.* FROM fl JOIN x ON x.file_id = fl.prev), n AS (SELECT fl.file_id AS fid, x.* FROM fl JOIN x ON x.file_id = fl.file_id WHERE prev IS NOT NULL),
hdr AS (SELECT coalesce(o.fid, n.fid) AS fid, o.h AS oh, n.h AS nh, o.f AS ofd, n.f AS nfd, o.ty AS oty, n.ty AS nty FROM o FULL JOIN n ON o.fid = n.fid AND o.k = n.k),
g AS (SELECT fid, oh, ofd AS f, oty FROM hdr WHERE nh IS NULL), e AS (SELECT fid, nh, nfd AS f, nty FROM hdr WHERE oh IS NULL),
p AS (SELECT coalesce(g.fid, e.fid) AS fid, oh, nh, oty, nty FROM g FULL JOIN e ON g.fid = e.fid AND g.f = e.f)
SELECT fid AS file_id, nh AS source_header, 'retyped' AS change_kind FROM hdr WHERE oh IS NOT NULL AND nh IS NOT NULL AND oty <> nty
UNION ALL SELECT fid, nh, 'renamed' FROM p WHERE oh IS NOT NULL AND nh IS NOT NULL UNION ALL SELECT fid, nh, 'retyped' FROM p WHERE oh IS NOT NULL AND nh IS NOT NULL AND oty <> nty
UNION ALL SELECT fid, nh, 'added' FROM p WHERE oh IS NULL UNION ALL SELECT fid, oh, 'removed' FROM p WHERE nh IS NULL"""
}
for _module in MODULES:
    QUERIES |= _module.R.queries
    SQL |= _module.R.sql
