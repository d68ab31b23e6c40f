"""Text, identifier and span queries over ``documents``, ``text_spans``, ``translations``, ``detections`` and others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import identifiers, text
from ledgerloom.operators import layout, sentences
from ledgerloom.plans import cells_sql
from ledgerloom.plans.registry import Registry
from ledgerloom.session import table

R = Registry()


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@R.add(r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x{00A0}]+', ' ', 'g'), ' +([,.;:!?।])', '\1', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM documents""")
def normalize_spacing(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.sha2(text.normalise_spacing(F.col("text")), 256).alias("digest"))


@R.add("SELECT span_id, translate(text, '०१२३४५६७८९', '0123456789') AS text FROM text_spans")
def deva_numerals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").select("span_id", text.ascii_numerals(F.col("text")).alias("text"))


_TEMPLATE = r"trim(regexp_replace(regexp_replace(lower(text), '[0-9]', '#', 'g'), '[ \t]+', ' ', 'g'))"


@R.add(f"SELECT doc_id, {_TEMPLATE} AS template, count(DISTINCT page_number) AS pages, count(*) AS spans FROM text_spans WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT page_number) >= 2")
def running_header_detect(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "text_spans").where("text is not null").groupBy("doc_id", text.header_template(F.col("text")).alias("template"))
    return x.agg(F.count_distinct("page_number").alias("pages"), F.count(F.lit(1)).alias("spans")).where("pages >= 2")


@R.add(f"""WITH h AS (SELECT doc_id, {_TEMPLATE} AS template FROM text_spans WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT page_number) >= 2)
SELECT s.span_id FROM text_spans s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = s.doc_id AND h.template = {_TEMPLATE.replace('(text)', '(s.text)')})""")
def anti_running_header(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "text_spans").withColumn("template", text.header_template(F.col("text")))
    return s.join(running_header_detect(spark, d).select("doc_id", "template"), ["doc_id", "template"], "left_anti").select("span_id")


def _critical_sql(c: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(trim({c}), '{p}') THEN '{n}'" for n, p in text.CRITICAL)
    return f"CASE WHEN length(trim({c})) >= 2 THEN CASE {cases} END END"


@R.add(f"SELECT span_id, {_critical_sql('text')} AS kind FROM text_spans")
def critical_span_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").select("span_id", text.critical_class(F.col("text")).alias("kind"))


_LABEL = text.LABEL


@R.add(f"""SELECT span_id, coalesce(regexp_matches(trim(lag(text) OVER (PARTITION BY doc_id, page_number ORDER BY span_id)), '{_LABEL}'), FALSE) AS anchored FROM text_spans""")
def label_anchor_propagation(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page_number").orderBy("span_id")
    return table(spark, d, "text_spans").select("span_id", F.coalesce(F.trim(F.lag("text").over(w)).rlike(_LABEL), F.lit(False)).alias("anchored"))


def _markers(words: tuple[str, ...]) -> str:
    return f"len(list_intersect(w, [{', '.join(repr(x) for x in words)}]))"


@R.add(rf"""WITH t AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\x{{0900}}-\x{{097F}}]')) AS deva, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, list_distinct(regexp_split_to_array(text, '[ \n\t.,।?!]+')) AS w FROM documents)
SELECT doc_id, CASE WHEN trim(text) = '' THEN 'unknown' WHEN deva > latin AND deva > 0 THEN CASE WHEN {_markers(text.MARATHI)} > 0 AND {_markers(text.MARATHI)} > {_markers(text.HINDI)} THEN 'mr'
WHEN {_markers(text.NEPALI)} > 0 AND {_markers(text.NEPALI)} > {_markers(text.HINDI)} THEN 'ne' ELSE 'hi' END WHEN latin > 0 THEN 'en' ELSE 'unknown' END AS lang FROM t""")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.script_language(F.col("text")).alias("lang"))


@R.add("SELECT result_id, coalesce(direction, CASE WHEN source_language IN ('hi', 'mr', 'ne') THEN 'hi-en' WHEN source_language = 'en' THEN 'en-hi' END) AS direction FROM translations")
def direction_resolve(spark: SparkSession, d: str) -> DataFrame:
    by = F.when(F.col("source_language").isin("hi", "mr", "ne"), "hi-en").when(F.col("source_language") == "en", "en-hi")
    return table(spark, d, "translations").select("result_id", F.coalesce("direction", by).alias("direction"))


_ROMAN = ("hai", "mein", "aapke", "ka", "ki", "ko", "nahi", "kiya", "aur", "kripya", "hain", "jama", "tak", "apne")


@R.add(rf"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT doc_id, len(list_intersect(w, [{', '.join(repr(x) for x in _ROMAN)}])) AS hits, len(list_intersect(w, [{', '.join(repr(x) for x in _ROMAN)}])) >= 2 OR (len(list_intersect(w, [{', '.join(repr(x) for x in _ROMAN)}])) >= 1 AND len(w) <= 3) AS romanised FROM t""")
def romanized_hindi_test(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(x) for x in _ROMAN])))
    return docs(spark, d).select("doc_id", F.when(F.col("text").isNotNull(), hits).cast("long").alias("hits"), F.when(F.col("text").isNotNull(), (hits >= 2) | ((hits >= 1) & (F.size(words) <= 3))).alias("romanised"))


@R.add(r"""WITH t AS (SELECT span_id, trim(regexp_replace(regexp_replace(text, '[^\x20-\x7E]+', ' ', 'g'), ' +', ' ', 'g')) AS x FROM text_spans) SELECT span_id, CASE WHEN regexp_matches(x, '[A-Za-z0-9]') THEN x ELSE '' END AS text FROM t""")
def script_filter_en(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").select("span_id", text.latin_only(F.col("text")).alias("text"))


@R.add(r"""WITH t AS (SELECT doc_id, trim(text) AS x FROM documents) SELECT doc_id, coalesce(length(x) > 0 AND len(regexp_extract_all(x, '\x{FFFD}')) / length(x) < 0.05 AND len(regexp_extract_all(x, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) / length(x) < 0.05, FALSE) AS usable FROM t""")
def usable_page(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.usable(F.col("text")).alias("usable"))


@R.add("SELECT doc_id, bool_and(coalesce(length(trim(text)) > 0, FALSE)) AS usable, count(*) AS spans FROM text_spans GROUP BY doc_id")
def usable_document(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").groupBy("doc_id").agg(F.bool_and(F.coalesce(F.length(F.trim("text")) > 0, F.lit(False))).alias("usable"), F.count(F.lit(1)).alias("spans"))


def _facts_sql(c: str) -> str:
    """Each kind of fact from what the kinds before it left over, as in the expression."""
    rest, parts = f"translate({c}, '०१२३४५६७८९', '0123456789')", []
    for kind, p in text.FACTS:
        plain = f"list_transform(regexp_extract_all({rest}, '({p})', 1), lambda t: lower(regexp_replace(t, ',| ', '', 'g')))"
        if kind == "money":
            signs = f"list_transform({plain}, lambda t: regexp_replace(regexp_replace(t, '[0-9.-]+$', ''), '^(₹|rs)$', 'inr'))"
            plain = f"{signs} || list_transform({plain}, lambda t: regexp_replace(t, '^[^0-9-]+', ''))"
        parts.append(plain)
        rest = f"regexp_replace({rest}, '{p}', ' ', 'g')"
    return " || ".join(parts)


@R.add(f"SELECT result_id, array_to_string({_facts_sql('source_text')}, '|') AS facts FROM translations")
def extract_factual_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations").select("result_id", F.array_join(text.facts(F.col("source_text")), "|").alias("facts"))


@R.add(f"""WITH t AS (SELECT result_id, source_text, translated_text FROM translations WHERE source_text IS NOT NULL AND translated_text IS NOT NULL),
a AS (SELECT result_id, unnest({_facts_sql('source_text')}) AS token FROM t), b AS (SELECT result_id, unnest({_facts_sql("replace(translated_text, '7', '1')")}) AS token FROM t),
x AS (SELECT result_id, token, count(*) AS n FROM a GROUP BY 1, 2), y AS (SELECT result_id, token, count(*) AS m FROM b GROUP BY 1, 2)
SELECT result_id, token, n AS source_count, coalesce(m, 0) AS target_count FROM x LEFT JOIN y USING (result_id, token) WHERE coalesce(m, 0) < n""")
def factual_multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translations").where("source_text is not null and translated_text is not null")
    # the target is a copy in which every 7 was misread; both sides in one aggregation: +1 for the source, target counted beside it
    sides = F.concat(F.transform(text.facts(F.col("source_text")), lambda x: F.struct(x.alias("token"), F.lit(1).alias("s"))), F.transform(text.facts(F.translate("translated_text", "7", "1")), lambda x: F.struct(x.alias("token"), F.lit(0).alias("s"))))
    x = t.select("result_id", F.explode(sides).alias("x")).groupBy("result_id", "x.token").agg(F.count_if(F.col("x.s") == 1).alias("source_count"), F.count_if(F.col("x.s") == 0).alias("target_count"))
    return x.where("target_count < source_count")


@R.add(r"""SELECT result_id, len(regexp_extract_all(translated_text, '[\x{0900}-\x{097F}]')) > 0.35 * length(translated_text) AND direction = 'hi-en' AS residue FROM translations""")
def factual_equivalence(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_count("translated_text", F.lit(r"[\x{0900}-\x{097F}]"))
    return table(spark, d, "translations").select("result_id", ((n > F.length("translated_text") * F.lit(0.35)) & (F.col("direction") == "hi-en")).alias("residue"))


@R.add(f"""WITH t AS (SELECT detection_id, nfc_normalize(lower(bank_name)) AS x, nfc_normalize(bank_name) AS y FROM detections)
SELECT detection_id, CASE WHEN length(x) = 0 THEN CASE WHEN length(y) = 0 THEN 0.0 ELSE 1.0 END ELSE CAST({cells_sql.distance('x', 'y')} AS DOUBLE) / length(x) END AS cer FROM t""")
def cer(spark: SparkSession, d: str) -> DataFrame:
    """How far typed names are from their form in small letters."""
    return table(spark, d, "detections").select("detection_id", text.character_error_rate(F.lower("bank_name"), F.col("bank_name")).alias("cer"))


@R.add(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '(Section|Rule|Article|Order) [0-9]+[A-Z]?') AS f FROM documents)
SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(f, range(1, len(f) + 1)), lambda z: list_position(f, z[1]) = z[2]), lambda z: z[1]), '|') AS refs FROM t""")
def statutory_refs(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.array_join(text.citations(F.col("text")), "|").alias("refs"))


@R.add(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z]{5}[0-9]{4}[A-Z]\b')) AS id FROM documents) SELECT doc_id, id, regexp_matches(id, '^[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]$') AS valid FROM t""")
def verify_pan(spark: SparkSession, d: str) -> DataFrame:
    ids = F.regexp_extract_all("text", F.lit(r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"), F.lit(1))
    return docs(spark, d).select("doc_id", F.explode(ids).alias("id")).withColumn("valid", identifiers.verify_pan(F.col("id")))


_B36 = identifiers.BASE36
_CHECK = f"substr('{_B36}', CAST((36 - list_sum(list_transform(range(1, 15), lambda i: (instr('{_B36}', substr(id, CAST(i AS INT), 1)) - 1) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END) // 36 + (instr('{_B36}', substr(id, CAST(i AS INT), 1)) - 1) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END) % 36)) % 36) % 36 + 1 AS INT), 1)"


@R.add(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]\b')) AS id FROM documents)
SELECT doc_id, id, {_CHECK} AS digit FROM t""")
def gstin_check_digit(spark: SparkSession, d: str) -> DataFrame:
    ids = F.regexp_extract_all("text", F.lit(r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z])\b"), F.lit(1))
    return docs(spark, d).select("doc_id", F.explode(ids).alias("id")).withColumn("digit", identifiers.gstin_check_digit(F.substring("id", 1, 14)))


@R.add(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]\b')) AS id FROM documents)
SELECT doc_id, id, (CAST(left(id, 2) AS INT) BETWEEN 1 AND 38 OR left(id, 2) IN ('97', '99')) AND regexp_matches(substr(id, 3, 10), '^[A-Z]{{3}}[ABCFGHJLPT][A-Z][0-9]{{4}}[A-Z]$') AND substr(id, 13, 1) <> '0' AND right(id, 1) = {_CHECK} AS valid FROM t""")
def verify_gstin(spark: SparkSession, d: str) -> DataFrame:
    ids = F.regexp_extract_all("text", F.lit(r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z])\b"), F.lit(1))
    return docs(spark, d).select("doc_id", F.explode(ids).alias("id")).withColumn("valid", identifiers.verify_gstin(F.col("id")))


@R.add(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[LU][0-9]{{5}}[A-Z]{{2}}[0-9]{{4}}[A-Z]{{3}}[0-9]{{6}}\b')) AS id FROM documents)
SELECT doc_id, id, substr(id, 7, 2) IN ({', '.join(repr(x) for x in identifiers.STATES)}) AND CAST(substr(id, 9, 4) AS INT) BETWEEN 1850 AND 2035 AND substr(id, 13, 3) IN ({', '.join(repr(x) for x in identifiers.OWNERSHIPS)}) AS valid FROM t""")
def verify_cin(spark: SparkSession, d: str) -> DataFrame:
    ids = F.regexp_extract_all("text", F.lit(r"\b([LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6})\b"), F.lit(1))
    return docs(spark, d).select("doc_id", F.explode(ids).alias("id")).withColumn("valid", identifiers.verify_cin(F.col("id")))


@R.add(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]{16}')) AS id FROM documents) SELECT doc_id, id, regexp_matches(upper(id), '^[A-Z]{4}[0-9]{12}$') AS valid FROM t""")
def verify_cnr(spark: SparkSession, d: str) -> DataFrame:
    """Every run of sixteen letters and digits, and whether it is a case number."""
    ids = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9]{16})"), F.lit(1))
    return docs(spark, d).select("doc_id", F.explode(ids).alias("id")).withColumn("valid", identifiers.verify_cnr(F.col("id")))


@R.add(r"""SELECT row_id, regexp_matches(trim(reference_number), '^[0-9]{8}$') AS din, regexp_matches(upper(trim(reference_number)), '^[A-Z]{4}[0-9]{5}[A-Z]$') AS tan FROM statement_rows""")
def verify_tan_din(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("reference_number")
    return table(spark, d, "statement_rows").select("row_id", identifiers.verify_din(c).alias("din"), identifiers.verify_tan(c).alias("tan"))


_SPOILT = "translate(ifsc, '0OIS', 'O0I5')"


@R.add("SELECT detection_id, regexp_matches(upper(trim(ifsc)), '^[A-Z]{4}0[A-Z0-9]{6}$') AS valid FROM detections")
def ifsc_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "detections").select("detection_id", identifiers.verify_ifsc(F.col("ifsc")).alias("valid"))


@R.add(rf"""WITH s AS (SELECT detection_id, ifsc, {_SPOILT} AS x FROM detections), f AS (SELECT *, translate(left(x, 4), '01582', 'OISBZ') || CASE WHEN regexp_matches(substr(x, 5, 1), '[1-9]') THEN substr(x, 5, 1) ELSE '0' END || substr(x, 6, 6) AS y FROM s)
SELECT detection_id, CASE WHEN length(x) = 11 AND regexp_matches(y, '^[A-Z]{{4}}0[A-Z0-9]{{6}}$') THEN y ELSE x END AS repaired FROM f""")
def ifsc_repair(spark: SparkSession, d: str) -> DataFrame:
    spoilt = F.translate("ifsc", "0OIS", "O0I5")
    return table(spark, d, "detections").select("detection_id", identifiers.repair_ifsc(spoilt).alias("repaired"))


@R.add(r"""WITH s AS (SELECT row_id, upper(regexp_replace(translate(reference_number, '05', 'OS'), '[\s\-_:/]', '', 'g')) AS x FROM statement_rows),
f AS (SELECT *, translate(x, 'ODQISBZ', '0001582') AS u, translate(left(x, 4), '01582', 'OISBZ') || translate(substr(x, 5, 12), 'ODQISBZ', '0001582') AS n, translate(left(x, 4), '01582', 'OISBZ') || substr(x, 5, 1) || translate(substr(x, 6, 17), 'ODQISBZ', '0001582') AS r FROM s),
k AS (SELECT *, CASE WHEN length(x) = 12 AND NOT regexp_matches(x, '^[A-Z]{4}') AND regexp_matches(u, '^[0-9]{12}$') THEN 'UPI' WHEN length(x) = 16 AND regexp_matches(n, '^[A-Z]{4}[0-9]{12}$') THEN 'NEFT' WHEN length(x) = 22 AND regexp_matches(r, '^[A-Z]{4}[R0-9][0-9]{17}$') THEN 'RTGS' END AS kind FROM f)
SELECT row_id, CASE kind WHEN 'UPI' THEN u WHEN 'NEFT' THEN n WHEN 'RTGS' THEN r ELSE x END AS value, kind FROM k""")
def utr_repair(spark: SparkSession, d: str) -> DataFrame:
    got = identifiers.repair_utr(F.translate("reference_number", "05", "OS"))
    return table(spark, d, "statement_rows").select("row_id", got.alias("x")).select("row_id", "x.value", "x.kind")


@R.add("""SELECT statement_id, substr(sha256(lower(trim(bank_name)) || ':' || lower(trim(account_key))), 1, 16) AS fingerprint, CASE WHEN length(account_key) > 4 THEN repeat('X', length(account_key) - 4) || right(account_key, 4) ELSE account_key END AS masked FROM statements""")
def account_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statements").select("statement_id", identifiers.fingerprint(F.col("bank_name"), F.col("account_key")).alias("fingerprint"), identifiers.mask_account(F.col("account_key")).alias("masked"))


@R.add("""SELECT row_id, statement_id || '_P' || CAST(page_number AS VARCHAR) || '_R' || lpad(CAST(row_index AS VARCHAR), CAST(greatest(2, length(CAST(row_index AS VARCHAR))) AS INTEGER), '0') AS location FROM statement_rows""")
def input_location(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statement_rows").select("row_id", identifiers.input_location(F.col("statement_id"), F.col("page_number"), F.col("row_index")).alias("location"))


@R.add(r"""SELECT mapping_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(source_header), '[^a-z0-9 \x{0900}-\x{097F}]+', ' ', 'g'), '(^| )(inr|rs)( |$)', ' ', 'g'), ' +', ' ', 'g')) AS header FROM column_mappings""")
def header_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "column_mappings").select("mapping_id", identifiers.header_normalise(F.col("source_header")).alias("header"))


@R.add(r"""SELECT span_id, md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]', '', 'g')) AS digest FROM text_spans""")
def xml_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").select("span_id", F.md5(text.xml_safe(F.col("text"))).alias("digest"))


@R.add(r"""SELECT doc_id, regexp_replace('cannot open /srv/data/' || coalesce(source, '') || '/x.pdf now', '(^| )/[^ ]+/[^ ]+', '\1<path>', 'g') AS message FROM documents""")
def sanitize_message(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("cannot open /srv/data/"), F.coalesce("source", F.lit("")), F.lit("/x.pdf now"))
    return docs(spark, d).select("doc_id", text.sanitise_message(made).alias("message"))


@R.add("""SELECT doc_id, page_number, avg(confidence) AS mean, min(confidence) AS low, max(confidence) AS high, avg(confidence) < 0.75 AS review, count(*) AS n FROM text_spans WHERE confidence IS NOT NULL GROUP BY 1, 2""")
def page_region_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").where("confidence is not null").groupBy("doc_id", "page_number").agg(
        F.avg("confidence").alias("mean"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), (F.avg("confidence") < 0.75).alias("review"), F.count(F.lit(1)).alias("n")
    )


@R.add(f"""WITH k AS (SELECT doc_id, page_number, span_id, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY confidence, span_id) AS r FROM text_spans WHERE confidence IS NOT NULL AND {_critical_sql('text')} IS NOT NULL)
SELECT doc_id, page_number, span_id, r AS rank FROM k WHERE r <= 3""")
def weakest_k_critical(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page_number").orderBy("confidence", "span_id")
    s = table(spark, d, "text_spans").where(F.col("confidence").isNotNull() & text.critical_class(F.col("text")).isNotNull())
    return s.select("doc_id", "page_number", "span_id", F.row_number().over(w).alias("rank")).where("rank <= 3")


@R.add("SELECT span_id, CAST(CASE WHEN bbox.x0 <= 200 THEN 100 WHEN bbox.x0 <= 400 THEN 300 ELSE 500 END AS DOUBLE) AS centre FROM text_spans WHERE bbox IS NOT NULL")
def join_nearest_column(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "text_spans").where("bbox is not null")
    return s.select("span_id", layout.nearest(F.col("bbox.x0"), [100.0, 300.0, 500.0]).alias("centre"))


@R.add("""SELECT span_id, CAST(floor((bbox.x0 + bbox.x1) / 2 / 150) AS BIGINT) AS col_ix, CAST(floor((bbox.y0 + bbox.y1) / 2 / 40) AS BIGINT) AS row_ix FROM text_spans WHERE bbox IS NOT NULL""")
def join_cell_geometry(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "text_spans").where("bbox is not null")
    return layout.cell_of(s, "bbox", 150.0, 40.0).select("span_id", "col_ix", "row_ix")


@R.add()
def line_from_spans(spark: SparkSession, d: str) -> DataFrame:
    return layout.lines_from_spans(table(spark, d, "text_spans"), ["doc_id", "page_number"], "span_id", "text", "bbox")


@R.add()
def reading_order_xycut(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(table(spark, d, "text_spans"), ["doc_id", "page_number"], "span_id", "bbox")


@R.add()
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(docs(spark, d), "doc_id", "text")


@R.add("""WITH l AS (SELECT DISTINCT trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT count(*) AS lines, sum(length(line)) AS chars FROM l WHERE line <> ''""")
def sentence_dedup(spark: SparkSession, d: str) -> DataFrame:
    lines = docs(spark, d).select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line")).where("line <> ''").distinct()
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@R.add(r"""WITH c AS (SELECT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS ch FROM text_spans) SELECT ch, count(*) AS n FROM c GROUP BY ch""")
def unmapped_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").select(F.explode(F.regexp_extract_all("text", F.lit(r"([^\x00-\x7F])"), F.lit(1))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


@R.add("""SELECT coalesce(detected_type, 'unknown') AS format, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def input_format_groups(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy(F.coalesce("detected_type", F.lit("unknown")).alias("format")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


_STATUTORY = r"(?i)gstin|income tax|(?-i:PAN|CIN)|assessment|tribunal"


@R.add(f"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '{_STATUTORY}')) AS n FROM documents) SELECT doc_id, n AS hits, n > 0 AS statutory, CASE WHEN n > 0 THEN least(0.6 + 0.05 * n, 0.95) ELSE 0.0 END::DOUBLE AS confidence FROM t""")
def statutory_doc_detect(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_count("text", F.lit(_STATUTORY))
    t = docs(spark, d).select("doc_id", n.cast("long").alias("hits"))
    return t.select("doc_id", "hits", (F.col("hits") > 0).alias("statutory"), F.when(F.col("hits") > 0, F.least(F.lit(0.6) + F.lit(0.05) * F.col("hits"), F.lit(0.95))).otherwise(0.0).alias("confidence"))


_ALIASES = (("date", "transaction date"), ("date", "txn date"), ("description", "narration"), ("description", "particulars"), ("debit", "withdrawal amt"), ("credit", "deposit amt"), ("balance", "closing balance"))


_TERMS = ("account", "balance", "cheque", "statement", "loan", "interest", "notice", "tax")


@R.add("""WITH t AS (SELECT DISTINCT lower(trim(source_text)) AS k, min(translated_text) OVER (PARTITION BY lower(trim(source_text))) AS v FROM translations WHERE source_text IS NOT NULL) SELECT r.result_id, t.v AS template FROM translations r LEFT JOIN t ON lower(trim(r.source_text)) = t.k""")
def join_court_template(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translations").withColumn("k", F.lower(F.trim("source_text")))
    return t.join(t.where("k is not null").groupBy("k").agg(F.min("translated_text").alias("template")), "k", "left").select("result_id", "template")


@R.add("SELECT doc_id FROM documents x WHERE NOT EXISTS (SELECT 1 FROM detections d WHERE d.doc_id = x.doc_id AND NOT d.is_bank_statement AND d.confidence_score < 0.5)")
def semi_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Documents still to be worked on: those that an unsure refusal has made terminal are kept out."""
    terminal = table(spark, d, "detections").where("not is_bank_statement and confidence_score < 0.5").select("doc_id")
    return docs(spark, d).join(terminal, "doc_id", "left_anti").select("doc_id")


@R.add("SELECT DISTINCT lower(trim(source_input_id)) AS path FROM documents WHERE source_input_id IS NOT NULL")
def path_dedup(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where("source_input_id is not null").select(F.lower(F.trim("source_input_id")).alias("path")).distinct()


@R.add("""SELECT doc_id, coalesce(document_id, 'doc') || '_' || regexp_replace(lower(coalesce(detected_type, 'unknown')), '[^a-z0-9]+', '-', 'g') || '.json' AS name FROM documents""")
def artifact_naming(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.concat(F.coalesce("document_id", F.lit("doc")), F.lit("_"), F.regexp_replace(F.lower(F.coalesce("detected_type", F.lit("unknown"))), "[^a-z0-9]+", "-"), F.lit(".json")).alias("name"))
