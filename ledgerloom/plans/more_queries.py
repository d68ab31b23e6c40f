"""Queries of the remaining operators: protection, legacy fonts, statutory extraction, profiles, tables, policies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, identifiers, legacy, protect
from ledgerloom.functions.text import any_script
from ledgerloom.operators import rows, statutory
from ledgerloom.plans import cells_sql
from ledgerloom.plans.registry import Registry
from ledgerloom.session import table
from ledgerloom.sources import files

R = Registry()
#: Characters of words and blanks of every script, for SQL, whose patterns look neither ahead nor behind: what stands around a
#: match is taken in and put back, twice, so that matches side by side are met too.
_W, _B = r"[\p{L}\p{N}_]", r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_EDGE, _CLOSE = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def _swap(column: str, pattern: str, new: str) -> str:
    once = lambda x: f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return once(once(column))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@R.add(f"SELECT row_id, {cells_sql.day('value_date')} AS day FROM statement_rows")
def parse_date(spark: SparkSession, d: str) -> DataFrame:
    """ISO first, then day before month, in ten formats."""
    return table(spark, d, "statement_rows").select("row_id", dates.parse_date("value_date").alias("day"))


@R.add(f"SELECT row_id, {cells_sql.time('time')} AS time FROM statement_rows")
def parse_time(spark: SparkSession, d: str) -> DataFrame:
    """Times of 24 and 12 hours."""
    return table(spark, d, "statement_rows").select("row_id", dates.parse_time("time").alias("time"))


@R.add("""SELECT row_id, CASE WHEN regexp_matches(trim(reference_number), '^[0-9]{6}$') AND regexp_matches(lower(description), 'chq|cheque|clg') THEN trim(reference_number) END AS cheque, CASE WHEN regexp_matches(trim(reference_number), '^[0-9]{6}$') AND regexp_matches(lower(description), 'chq|cheque|clg') THEN NULL ELSE trim(reference_number) END AS ref FROM statement_rows""")
def ref_vs_cheque_split(spark: SparkSession, d: str) -> DataFrame:
    r = F.trim("reference_number")
    cheque = F.coalesce(r.rlike("^[0-9]{6}$") & F.lower("description").rlike("chq|cheque|clg"), F.lit(False))
    return table(spark, d, "statement_rows").select("row_id", F.when(cheque, r).alias("cheque"), F.when(~cheque, r).alias("ref"))


@R.add("SELECT statement_id, coalesce(nullif(trim(currency), ''), 'INR') AS currency FROM statements")
def statement_currency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statements").select("statement_id", F.coalesce(F.nullif(F.trim("currency"), F.lit("")), F.lit("INR")).alias("currency"))


@R.add("SELECT doc_id, substr(sha256(text), 1, 12) AS fingerprint FROM documents")
def doc_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("fingerprint"))


@R.add("SELECT statement_id, 'st_' || substr(sha256(lower(trim(account_key)) || ':' || lower(trim(CAST(period_start AS VARCHAR)))), 1, 16) AS made_id FROM statements")
def statement_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statements").select("statement_id", F.concat(F.lit("st_"), identifiers.fingerprint(F.col("account_key"), F.col("period_start").cast("string"))).alias("made_id"))


@R.add("SELECT transaction_id, sha256(account_key || '|' || transaction_date || '|' || coalesce(description, '')) AS hash FROM transactions")
def transaction_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transactions").select("transaction_id", F.sha2(F.concat_ws("|", "account_key", "transaction_date", F.coalesce("description", F.lit(""))), 256).alias("hash"))


@R.add("WITH c AS (SELECT detection_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY confidence_score DESC, detection_id) AS r FROM detections) SELECT detection_id, doc_id FROM c WHERE r = 1")
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by("detection_id", F.struct("confidence_score", -F.col("detection_id")))
    return table(spark, d, "detections").groupBy("doc_id").agg(best.alias("detection_id"))


@R.add("SELECT statement_id, row_number() OVER (PARTITION BY account_key ORDER BY period_start, period_end, statement_id) AS position FROM statements")
def statement_sort(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("account_key").orderBy("period_start", "period_end", "statement_id")
    return table(spark, d, "statements").select("statement_id", F.row_number().over(w).alias("position"))


@R.add("SELECT transaction_id, row_number() OVER (PARTITION BY account_key ORDER BY loaded_at, transaction_id) AS position FROM transactions")
def tx_sort(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("account_key").orderBy("loaded_at", "transaction_id")
    return table(spark, d, "transactions").select("transaction_id", F.row_number().over(w).alias("position"))


@R.add("""WITH a AS (SELECT DISTINCT event_type FROM events WHERE user_id % 2 = 0), b AS (SELECT DISTINCT event_type FROM events WHERE user_id % 2 = 1) SELECT event_type FROM a UNION SELECT event_type FROM b""")
def union_stage_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where("user_id % 2 = 0").select("event_type").union(e.where("user_id % 2 = 1").select("event_type")).distinct()


_MERGED = "list_concat(reasons, ['keyword hit', 'manual'])"


@R.add(f"""SELECT detection_id, array_to_string(list_transform(list_filter(list_zip({_MERGED}, range(1, len({_MERGED}) + 1)), lambda z: list_position({_MERGED}, z[1]) = z[2]), lambda z: z[1]), ',') AS reasons FROM detections""")
def plan_stage_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stages of two plans, each once, in the order of their first place."""
    both = F.array_distinct(F.concat("reasons", F.array(F.lit("keyword hit"), F.lit("manual"))))
    return table(spark, d, "detections").select("detection_id", F.array_join(both, ",").alias("reasons"))


@R.add("SELECT detection_id, len(list_intersect(reasons, ['keyword hit', 'ifsc found'])) AS hits FROM detections")
def token_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "detections").select("detection_id", F.size(F.array_intersect("reasons", F.array(F.lit("keyword hit"), F.lit("ifsc found")))).cast("long").alias("hits"))


@R.add("SELECT mapping_id, last_value(canonical_field IGNORE NULLS) OVER (PARTITION BY feed_id, column_index ORDER BY period_start, mapping_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS field FROM column_mappings")
def header_memory(spark: SparkSession, d: str) -> DataFrame:
    """Columns without a field take the last one seen in their place."""
    w = Window.partitionBy("feed_id", "column_index").orderBy("period_start", "mapping_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "column_mappings").select("mapping_id", F.last("canonical_field", ignorenulls=True).over(w).alias("field"))


_CELLS = ["date", "value_date", "time", "description", "reference_number", "debit", "credit", "balance"]
_GLUE = "CASE WHEN n.c[{i}] IS NULL OR trim(n.c[{i}]) = '' THEN o.c[{i}] WHEN trim(coalesce(o.c[{i}], '')) = '' THEN trim(n.c[{i}]) WHEN trim(n.c[{i}]) IN ('CR', 'DR', 'Cr', 'Dr') THEN trim(o.c[{i}]) || trim(n.c[{i}]) ELSE trim(o.c[{i}]) || ' ' || trim(n.c[{i}]) END"


@R.add(f"""WITH r AS (SELECT row_id, statement_id, page_number, row_index, [{', '.join(_CELLS)}] AS c FROM statement_rows),
e AS (SELECT statement_id, page_number, arg_min(struct_pack(row_id := row_id, c := c), struct_pack(a := row_index, b := row_id)) AS top, arg_max(struct_pack(row_id := row_id, c := c), struct_pack(a := row_index, b := row_id)) AS low FROM r GROUP BY 1, 2),
q AS (SELECT lag(low) OVER (PARTITION BY statement_id ORDER BY page_number) AS o, top AS n FROM e),
k AS (SELECT o, n, trim(replace(coalesce(o.c[1], ''), chr(10), '')) AS od, trim(replace(coalesce(n.c[1], ''), chr(10), '')) AS nd, list_filter(list_transform(n.c, lambda v: trim(coalesce(v, ''))), lambda v: v <> '') AS f FROM q WHERE o IS NOT NULL),
j AS (SELECT o.row_id AS row_id, n.row_id AS gone, [CASE WHEN regexp_matches(od, '[0-9]{{1,2}}-$') AND regexp_full_match(nd, '[0-9]{{2,4}}|[0-9]{{1,2}}-[0-9]{{2,4}}') THEN od || nd ELSE od END, {', '.join(_GLUE.format(i=i) for i in range(2, 9))}] AS c FROM k
  WHERE (regexp_matches(od, '[0-9]{{1,2}}-$') AND regexp_full_match(nd, '[0-9]{{2,4}}|[0-9]{{1,2}}-[0-9]{{2,4}}')) OR (nd = '' AND len(f) BETWEEN 1 AND 2 AND len(list_filter(f, lambda v: regexp_full_match(v, '[0-9,]+\\.[0-9]{{2}}'))) = 0
  AND regexp_matches(od, '[0-9]{{1,2}}[/.-][\\p{{L}}\\p{{N}}_]{{3,}}[/.-][0-9]{{2,4}}|[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}')))
SELECT r.row_id, r.statement_id, r.page_number, r.row_index, {', '.join(f'CASE WHEN j.row_id IS NULL THEN r.c[{i}] ELSE j.c[{i}] END AS {c}' for i, c in enumerate(_CELLS, 1))}, j.row_id IS NOT NULL AS stitched FROM r LEFT JOIN j USING (row_id) WHERE r.row_id NOT IN (SELECT gone FROM j)""")
def table_stitch(spark: SparkSession, d: str) -> DataFrame:
    """Rows of statements, those that a page break cut in two put together."""
    cells = _CELLS
    x = table(spark, d, "statement_rows").select("row_id", "statement_id", "page_number", "row_index", *cells)
    return rows.stitched_rows(x, "statement_id", "page_number", "row_index", "row_id", cells)


@R.add()
def overlap_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Of overlapping matches, the first, and of those that start together the longest; a fold over the sorted array."""
    found = protect.apply_rows(docs(spark, d), "doc_id", "text", "a int, b int", lambda t: [(m.start(), m.end()) for p in protect.KEEP for m in re.finditer(p[1], t)])
    spans = F.array_sort(F.collect_list(F.struct("a", (-F.col("b")).alias("e"))))
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("kept"))
    fold = F.aggregate("s", start, lambda acc, x: F.when(x["a"] >= acc["end"], F.struct((-x["e"]).alias("end"), (acc["kept"] + 1).alias("kept"))).otherwise(acc))
    return found.groupBy("doc_id").agg(spans.alias("s")).select("doc_id", fold["kept"].alias("kept"), F.size("s").alias("found"))


@R.add()
def span_protect(spark: SparkSession, d: str) -> DataFrame:
    """Entities out and back again: the result must be the text."""
    return protect.apply_rows(table(spark, d, "translations"), "result_id", "source_text", "protected string, spans int, whole boolean", lambda t: [((p := protect.protect(t))[0], len(p[1]), protect.restore(*p) == (t, []))])


@R.add()
def transliterate_hinglish(spark: SparkSession, d: str) -> DataFrame:
    words = docs(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b([a-z]{2,})\b"), F.lit(1))).alias("word")).distinct()
    return protect.apply_rows(words, "word", "word", "devanagari string", lambda w: [(protect.transliterate(w),)])


_TERMS = {"account": "खाता", "statement": "विवरण", "cheque": "चेक", "savings account": "बचत खाता", "branch": "शाखा"}


_HARMONY = (("cheque" + _B + "*book" + _CLOSE, "chequebook"), ("pass" + _B + "*book" + _CLOSE, "passbook"), ("e-?mail" + _CLOSE, "email"), ("A/c" + _CLOSE, "account"), (r"Rs\.?" + _B + r"*(\p{Nd})", "INR "))
_HARMONISED = "text"
for _pattern, _word in _HARMONY:
    _HARMONISED = _swap(_HARMONISED, f"(?i){_EDGE}{_pattern}", rf"\1{_word}\2")


@R.add(f"SELECT doc_id, md5({_HARMONISED}) AS digest FROM documents")
def harmonize(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(protect.harmonise(F.col("text"))).alias("digest"))


@R.add(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{_B}+([,.;:)\]])', '\1', 'g'), '([(\[]){_B}+', '\1', 'g'), '{_B}*/{_B}*', '/', 'g')) AS digest FROM documents""")
def clean_legal_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(protect.clean_legal(F.col("text"))).alias("digest"))


_COURTS = ("Supreme Court", "High Court", "Appellate Tribunal", "appellate tribunal", "adjudicating authority")


@R.add("SELECT doc_id, CASE " + " ".join(f"WHEN contains(text, '{c}') THEN '{c}'" for c in _COURTS) + " END AS court FROM documents")
def court_name(spark: SparkSession, d: str) -> DataFrame:
    out = F.lit(None).cast("string")
    for c in reversed(_COURTS):
        out = F.when(F.col("text").contains(c), c).otherwise(out)
    return docs(spark, d).select("doc_id", out.alias("court"))


@R.add()
def split_clauses(spark: SparkSession, d: str) -> DataFrame:
    return protect.apply_rows(docs(spark, d), "doc_id", "text", "clause_no int, clause string", lambda t: list(enumerate(protect.clauses(t))))


@R.add()
def chunk_long_sentence(spark: SparkSession, d: str) -> DataFrame:
    cut = lambda t: [(n, c) for n, c in enumerate(c for s, _ in protect.pieces(t) for c in protect.chunks(s, 32))]
    return protect.apply_rows(docs(spark, d), "doc_id", "text", "chunk_no int, chunk string", cut)


@R.add()
def script_segments(spark: SparkSession, d: str) -> DataFrame:
    return protect.apply_rows(table(spark, d, "text_spans"), "span_id", "text", "script string, piece string", protect.script_segments)


@R.add()
def font_convert(spark: SparkSession, d: str) -> DataFrame:
    """Hindi spans put into glyph codes and converted back."""
    s = table(spark, d, "text_spans").where(F.col("text").rlike(r"^[\x{0905}-\x{094D} ]+$"))
    return s.select("span_id", "text", legacy.converted(legacy.reversed_column(F.col("text"))).alias("back"))


@R.add()
def font_reverse(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "text_spans").where(F.col("text").rlike(r"[\x{0900}-\x{097F}]"))
    return s.select("span_id", legacy.reversed_column(F.col("text")).alias("codes"))


@R.add()
def akshara_synthesis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").select("span_id", legacy.composed(F.col("text")).alias("text"))


@R.add()
def macroman_fix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").select("span_id", legacy.by_text(legacy.mac_repair, F.col("text")).alias("text"))


@R.add(r"""SELECT span_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(^|\s)[\x{093E}-\x{094D}]') THEN 'LEADING_SIGN' END, CASE WHEN regexp_matches(text, '\x{094D}\x{094D}') THEN 'DOUBLE_VIRAMA' END,
CASE WHEN regexp_matches(text, '[\x{093E}-\x{094C}][\x{093E}-\x{094C}]') THEN 'DOUBLE_SIGN' END, CASE WHEN regexp_matches(text, '\x{094D}[\x{093E}-\x{094C}]') THEN 'SIGN_AFTER_VIRAMA' END], lambda x: x IS NOT NULL), ',') AS defects FROM text_spans""")
def deva_structure_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").select("span_id", F.array_join(legacy.structure_defects(F.col("text")), ",").alias("defects"))


@R.add()
def legacy_text_test(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").select("span_id", legacy.legacy_text(F.col("text")).alias("legacy"), legacy.signature_score(F.col("text")).alias("score"))


@R.add()
def mapping_coverage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").select("span_id", legacy.coverage(F.col("text")).alias("coverage"))


@R.add()
def decide_run_profile(spark: SparkSession, d: str) -> DataFrame:
    font = F.when(F.col("script") == "Deva", "Mangal").when(F.col("script").isNull(), "Kruti Dev 010").otherwise("Times New Roman")
    return table(spark, d, "text_spans").select("span_id", legacy.run_profile(font, F.col("text")).alias("profile"))


@R.add("""WITH s AS (SELECT span_id, doc_id, page_number, coalesce(script, '-') AS script, confidence, CASE WHEN coalesce(script, '-') IS DISTINCT FROM lag(coalesce(script, '-')) OVER w THEN 1 ELSE 0 END AS new FROM text_spans WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY span_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_number ORDER BY span_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM s) SELECT doc_id, page_number, CAST(run AS BIGINT) AS run, min(script) AS script, min(confidence) AS confidence, count(*) AS spans FROM g GROUP BY 1, 2, 3""")
def font_run_stitch(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page_number").orderBy("span_id")
    s = table(spark, d, "text_spans").withColumn("script", F.coalesce("script", F.lit("-")))
    s = s.withColumn("new", F.when(F.col("script").eqNullSafe(F.lag("script").over(w)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.groupBy("doc_id", "page_number", "run").agg(F.min("script").alias("script"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("spans"))


@R.add()
def extract_statutory(spark: SparkSession, d: str) -> DataFrame:
    return statutory.extract(docs(spark, d), "doc_id", "text")


@R.add()
def statutory_roles(spark: SparkSession, d: str) -> DataFrame:
    return statutory.roles(docs(spark, d), "doc_id", "text", statutory.extract(docs(spark, d), "doc_id", "text"))


@R.add()
def sink_statutory_json(spark: SparkSession, d: str) -> DataFrame:
    return statutory.as_json(statutory.extract(docs(spark, d), "doc_id", "text"), "doc_id")


@R.add(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z]{5}[0-9]{4}[A-Z]\b')) AS id FROM documents), m AS (SELECT doc_id, id, translate(id, '01', 'OI') AS bad FROM t),
f AS (SELECT *, translate(left(bad, 5), '01582', 'OISBZ') || translate(substr(bad, 6, 4), 'OILSBZ', '011582') || translate(right(bad, 1), '01582', 'OISBZ') AS x FROM m) SELECT doc_id, bad, CASE WHEN regexp_matches(x, '^[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]$') THEN x ELSE bad END AS repaired FROM f""")
def repair_pan(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"), F.lit(1))).alias("id")).withColumn("bad", F.translate("id", "01", "OI"))
    return x.select("doc_id", "bad", identifiers.repair_pan(F.col("bad")).alias("repaired"))


@R.add()
def repair_gstin(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z])\b"), F.lit(1))).alias("id"))
    bad = F.concat(F.translate(F.substring("id", 1, 2), "0", "O"), F.substring("id", 3, 13))
    return x.withColumn("bad", bad).withColumn("repaired", statutory.repair_gstin(bad))


#: Layouts: names of headers by field that a file of each kind has.
_PROFILES = {"amounts": ("debit", "credit", "balance"), "direction": ("direction", "balance"), "cheques": ("cheque_number", "debit"), "dated": ("date", "value_date", "posting_date")}


def _profile_case() -> str:
    return ", ".join(f"('{p}', '{f}')" for p, fs in _PROFILES.items() for f in fs)


_WORDS = {"bank_letter": "account|balance|cheque", "tax_notice": "assessment|tax", "court_order": "tribunal|petitioner|order", "invoice": "invoice|gstin"}
_HITS = {k: f"len(regexp_extract_all(lower(text), '{p}'))" for k, p in _WORDS.items()}


@R.add("WITH s AS (SELECT doc_id, " + ", ".join(f"{sql} AS {k}" for k, sql in _HITS.items()) + " FROM documents WHERE text IS NOT NULL), b AS (SELECT *, greatest(" + ", ".join(_WORDS) + ") AS top FROM s) SELECT doc_id, top AS score, CASE WHEN top = 0 OR " + " + ".join(f"CAST({k} = top AS INT)" for k in _WORDS) + " > 1 THEN 'generic' " + " ".join(f"WHEN {k} = top THEN '{k}'" for k in _WORDS) + " END AS profile FROM b")
def join_detect_profile(spark: SparkSession, d: str) -> DataFrame:
    """Keyword evidence by kind; a tie goes to 'generic'."""
    x = docs(spark, d).where("text is not null").select("doc_id", *[F.regexp_count(F.lower("text"), F.lit(p)).alias(k) for k, p in _WORDS.items()])
    top = F.greatest(*[F.col(k) for k in _WORDS])
    ties = sum((F.when(F.col(k) == top, 1).otherwise(0) for k in _WORDS), F.lit(0))
    out = F.when((top == 0) | (ties > 1), "generic")
    for k in _WORDS:
        out = out.when(F.col(k) == top, k)
    return x.select("doc_id", top.cast("long").alias("score"), out.alias("profile"))


@R.add()
def profile_rank(spark: SparkSession, d: str) -> DataFrame:
    best = legacy.profile_rank(F.col("text"))[0]
    return table(spark, d, "text_spans").where("text is not null").select("span_id", best["profile"].alias("profile"), best["score"].alias("score"))


@R.add(r"""SELECT span_id, len(regexp_extract_all(text, '[\x{0900}-\x{097F}][A-Za-z\[{>]|[A-Za-z\[{>][\x{0900}-\x{097F}]')) AS residual FROM text_spans""")
def residual_legacy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").select("span_id", legacy.residual(F.col("text")).cast("long").alias("residual"))


@R.add("""SELECT span_id, CASE WHEN script = 'Deva' THEN 'preserve' WHEN script IS NULL THEN 'typewriter' ELSE 'preserve' END AS family FROM text_spans""")
def font_name_resolve(spark: SparkSession, d: str) -> DataFrame:
    font = F.when(F.col("script") == "Deva", "Mangal").when(F.col("script").isNull(), "Kruti Dev 010").otherwise("Times New Roman")
    return table(spark, d, "text_spans").select("span_id", legacy.font_family(font).alias("family"))


@R.add()
def intake_discovery(spark: SparkSession, d: str) -> DataFrame:
    """The files of the folder with their sizes, digests and formats."""
    found = files.discover(spark, d, recursive=True)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "fingerprint", "format")


@R.add("""WITH l AS (SELECT row_id, statement_id, lag(row_id) OVER (PARTITION BY statement_id ORDER BY page_number, row_index, row_id) AS prev FROM statement_rows) SELECT row_id, prev FROM l""")
def join_adjacent_rows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("statement_id").orderBy("page_number", "row_index", "row_id")
    return table(spark, d, "statement_rows").select("row_id", F.lag("row_id").over(w).alias("prev"))


@R.add("""WITH e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id FROM e WHERE k > 20""")
def checkpoint_evict(spark: SparkSession, d: str) -> DataFrame:
    """All but the twenty newest of each key."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k > 20").select("user_id", "event_id")
