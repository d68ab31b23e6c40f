"""Queries that map headers, profiles, terms and statutory facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import identifiers, protect
from ledgerloom.operators import ledger
from ledgerloom.plans import cells_sql
from ledgerloom.plans.registry import Registry
from ledgerloom.session import table

R = Registry()

#: Headers that are known without any mapping: field and label.
ALIASES = tuple(
    (field, label)
    for field, labels in {
        "date": "date|transaction date|txn date|tran date|post date", "value_date": "value date|val date|effective date", "description": "description|narration|particulars|details|remarks",
        "reference_number": "reference number|ref no|utr|utr no", "cheque_number": "cheque number|chq no|cheque no|instrument no", "debit": "debit|withdrawal|withdrawals|withdrawal amt|paid out|money out",
        "credit": "credit|deposit|deposits|deposit amt|paid in|money in", "balance": "balance|closing balance|running balance|available balance", "direction": "dr cr|type|direction",
    }.items()
    for label in labels.split("|")
)
_HEADER = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_KNOWN = ", ".join(f"('{f}', '{a}')" for f, a in ALIASES)


@R.add(f"""WITH m AS (SELECT file_id, column_index, {_HEADER.format('source_header')} AS h, arg_min(canonical_field, mapping_id) AS cf FROM column_mappings WHERE source_header IS NOT NULL AND file_id IS NOT NULL AND column_index IS NOT NULL GROUP BY 1, 2, 3),
seen AS (SELECT h, cf, count(*) AS n FROM m WHERE cf IS NOT NULL AND h <> '' GROUP BY 1, 2), k(field, label) AS (VALUES {_KNOWN}),
a AS (SELECT label AS h, field FROM k UNION ALL SELECT h, arg_max(cf, struct_pack(n := n, c := cf)) FROM seen WHERE h NOT IN (SELECT label FROM k) GROUP BY h),
d AS (SELECT DISTINCT h FROM m WHERE h <> '' AND h NOT IN (SELECT h FROM a)),
s AS (SELECT d.h, a.h AS alias, field, 1 - levenshtein(d.h, a.h) / greatest(length(d.h), length(a.h))::DOUBLE AS score FROM d, a),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY score DESC, alias) AS k, lead(score) OVER (PARTITION BY h ORDER BY score DESC, alias) AS second FROM s WHERE score >= 0.8),
g AS (SELECT h, field, CASE WHEN score >= 0.92 THEN 'CLOSE' ELSE 'CLEAR' END AS how FROM r WHERE k = 1 AND (score >= 0.92 OR (score >= 0.85 AND score - coalesce(second, 0) >= 0.05))),
b AS (SELECT m.file_id, m.column_index, m.h AS header, coalesce(a.field, g.field) AS field, CASE WHEN a.field IS NOT NULL THEN 'EXACT' ELSE g.how END AS how FROM m LEFT JOIN a ON a.h = m.h LEFT JOIN g ON g.h = m.h)
SELECT file_id, column_index, header, field, how FROM (SELECT *, row_number() OVER (PARTITION BY file_id, field ORDER BY column_index, header) AS nth FROM b WHERE field IS NOT NULL) WHERE nth = 1""")
def join_header_alias(spark: SparkSession, d: str) -> DataFrame:
    """Columns of files to fields: by known labels, by what other files' mappings show, else by the nearest label that is clearly
    nearer than the next; each field of a file is used once, from left to right."""
    key = F.trim(F.regexp_replace(F.lower("source_header"), "[^a-z0-9]+", " "))
    m = table(spark, d, "column_mappings").where("source_header is not null and file_id is not null and column_index is not null")
    m = m.groupBy("file_id", "column_index", key.alias("h")).agg(F.min_by("canonical_field", "mapping_id").alias("cf"))
    known = spark.createDataFrame([(label, field) for field, label in ALIASES], "h string, field string")
    seen = m.where("cf is not null and h <> ''").groupBy("h", "cf").count().groupBy("h").agg(F.max_by("cf", F.struct("count", "cf")).alias("field"))
    a = known.unionByName(seen.join(F.broadcast(known), "h", "left_anti"))
    open_headers = m.where("h <> ''").select("h").distinct().join(a, "h", "left_anti")
    both = open_headers.select("h").union(a.select("h")).distinct().select(F.lit(0).alias("block"), F.col("h").alias("t"))
    near = ledger.similar_texts(both, 0.8).select(F.col("a").alias("h"), F.col("b").alias("alias"))
    score = 1 - F.levenshtein("h", "alias") / F.greatest(F.length("h"), F.length("alias"))
    s = near.join(open_headers, "h", "left_semi").join(a.withColumnRenamed("h", "alias"), "alias").withColumn("score", score)
    w = Window.partitionBy("h").orderBy(F.desc("score"), "alias")
    r = s.withColumn("k", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("k = 1")
    g = r.where((F.col("score") >= 0.92) | ((F.col("score") >= 0.85) & (F.col("score") - F.col("second") >= 0.05))).select("h", F.col("field").alias("near"), F.when(F.col("score") >= 0.92, "CLOSE").otherwise("CLEAR").alias("how"))
    b = m.join(a, "h", "left").join(g, "h", "left").select("file_id", "column_index", F.col("h").alias("header"), F.coalesce("field", "near").alias("field"), F.when(F.col("field").isNotNull(), "EXACT").otherwise(F.col("how")).alias("how"))
    nth = F.row_number().over(Window.partitionBy("file_id", "field").orderBy("column_index", "header"))
    return b.where("field is not null").withColumn("nth", nth).where("nth = 1").drop("nth")


#: What a file of each layout has, and how much each field counts; below the threshold it is of none.
PROFILES = {
    "two_amounts": {"date": 1.0, "description": 1.0, "debit": 1.5, "credit": 1.5, "balance": 1.0}, "one_amount": {"date": 1.0, "description": 1.0, "direction": 2.5, "balance": 1.0},
    "cheques": {"date": 1.0, "cheque_number": 2.0, "debit": 1.0, "credit": 1.0}, "two_dates": {"date": 1.0, "value_date": 2.0, "description": 1.0, "balance": 1.0, "debit": 0.5},
}
LEAST = 4.0
_PROFILE_ROWS = ", ".join(f"('{p}', '{f}', {w})" for p, fs in PROFILES.items() for f, w in fs.items())


@R.add(f"""WITH p(profile, field, weight) AS (VALUES {_PROFILE_ROWS}), f AS (SELECT DISTINCT file_id, canonical_field AS field FROM column_mappings WHERE canonical_field IS NOT NULL), s AS (SELECT file_id, profile, CAST(sum(weight) AS DOUBLE) AS score FROM f JOIN p USING (field) GROUP BY 1, 2),
t AS (SELECT *, max(score) OVER (PARTITION BY file_id) AS top FROM s), b AS (SELECT file_id, top AS score, count(*) AS ties, min(profile) AS profile FROM t WHERE score = top GROUP BY 1, 2)
SELECT file_id, score, CASE WHEN score < {LEAST} OR ties > 1 THEN 'generic' ELSE profile END AS profile FROM b""")
def join_profile_score(spark: SparkSession, d: str) -> DataFrame:
    """Files against layouts by the weights of the fields they share: the best one, unless it is below the threshold or tied."""
    p = F.broadcast(spark.createDataFrame([(n, f, w) for n, fs in PROFILES.items() for f, w in fs.items()], "profile string, field string, weight double"))
    f = table(spark, d, "column_mappings").where("canonical_field is not null").select("file_id", F.col("canonical_field").alias("field")).distinct()
    s = f.join(p, "field").groupBy("file_id", "profile").agg(F.sum("weight").alias("score"))
    best = s.groupBy("file_id", "score").agg(F.count(F.lit(1)).alias("ties"), F.min("profile").alias("profile")).groupBy("file_id").agg(F.max(F.struct("score", "ties", "profile")).alias("b"))
    return best.select("file_id", "b.score", F.when((F.col("b.score") < LEAST) | (F.col("b.ties") > 1), "generic").otherwise(F.col("b.profile")).alias("profile"))


#: Terms whose translation is fixed.
TERMS = (
    "fixed deposit", "savings account", "current account", "account statement", "cheque book", "interest rate", "home loan", "income tax", "demand draft", "identity proof", "power of attorney", "high court", "show cause notice",
    "account", "balance", "branch", "cheque", "deposit", "interest", "invoice", "loan", "notice", "petition", "statement", "tax", "tribunal", "withdrawal",
)
#: Longest first, so that a longer term takes its words from the shorter ones.
_ORDERED = sorted(TERMS, key=lambda t: (-len(t), t))
_EDGED = [r"(^|[^A-Za-z0-9_])" + t + r"($|[^A-Za-z0-9_])" for t in _ORDERED]


def _terms_sql() -> str:
    rest, parts = "lower(text)", []
    for t, p in zip(_ORDERED, _EDGED):
        parts.append(f"CASE WHEN regexp_matches({rest}, '{p}') THEN '{t}' END")
        if " " in t:
            rest = f"regexp_replace({rest}, '{p}', '\\1#\\2', 'g')"
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda t: t IS NOT NULL), ',')"


@R.add(f"SELECT doc_id, {_terms_sql()} AS terms FROM documents")
def join_glossary(spark: SparkSession, d: str) -> DataFrame:
    """The terms of a glossary in each document, longer ones first; words of a longer term aren't found again."""
    return table(spark, d, "documents").select("doc_id", protect.glossary_terms(F.col("text"), _ORDERED).alias("terms"))


#: Facts of statutory documents, each as the first group of a pattern.
FIELDS = {
    "invoice_no": r"(?i:invoice)(?: ?(?i:no|number))?[.:# ]+([A-Z0-9][A-Z0-9/-]*[0-9][A-Z0-9/-]*)", "assessment_year": r"(?i:assessment year|A\.?Y\.?)[ :]*(20[0-9]{2}-[0-9]{2,4})", "acknowledgement": r"(?i:acknowledge?ment)(?: ?(?i:no|number))?[.:# ]+([0-9]{8,20})",
    "case_no": r"(?i:case|appeal|petition|suit|matter)(?: ?(?i:no|number|numbered))[.:# ]+([A-Z0-9][A-Z0-9/()-]*[0-9][A-Z0-9/()-]*)", "din": r"(?:DIN|(?i:director identification number))[.:# ]+([0-9]{8})(?:[^0-9]|$)", "section": r"(?i:section|u/s) ([0-9]+[A-Z]*(?:\([0-9a-z]+\))*)",
}


@R.add(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, unnest(list_distinct(regexp_extract_all(text, '{p}', 1))) AS value FROM documents" for k, p in FIELDS.items()))
def statutory_fields(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of invoices, cases, years and sections, each value of a document once."""
    found = F.array(*[F.struct(F.lit(k).alias("field"), F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(1))).alias("values")) for k, p in FIELDS.items()])
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(found).alias("f"))
    return x.select("doc_id", "f.field", F.explode("f.values").alias("value"))


@R.add("""WITH t AS (SELECT account_key, coalesce(currency, 'INR') AS currency, sum(debit) AS d, sum(credit) AS c, count(*) AS n FROM transactions GROUP BY 1, 2)
SELECT account_key, count(*) AS currencies, sum(n)::BIGINT AS rows, CASE WHEN count(*) = 1 THEN CAST(CAST(sum(d) AS DECIMAL(28,2)) AS VARCHAR) END AS total_debit, CASE WHEN count(*) = 1 THEN CAST(CAST(sum(c) AS DECIMAL(28,2)) AS VARCHAR) END AS total_credit,
CASE WHEN count(*) > 1 THEN 'MIXED_CURRENCIES' END AS issue FROM t GROUP BY 1""")
def account_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each account; none, but an issue, where its rows are in several currencies."""
    t = table(spark, d, "transactions").groupBy("account_key", F.coalesce("currency", F.lit("INR")).alias("currency")).agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.count(F.lit(1)).alias("n"))
    one = F.count(F.lit(1)) == 1
    total = lambda c: F.when(one, F.sum(c).cast("decimal(28,2)").cast("string"))
    return t.groupBy("account_key").agg(F.count(F.lit(1)).alias("currencies"), F.sum("n").alias("rows"), total("d").alias("total_debit"), total("c").alias("total_credit"), F.when(~one, "MIXED_CURRENCIES").alias("issue"))


@R.add(r"""WITH p AS (SELECT regexp_split_to_array(lower(trim(source_text)), '[ \n\t]+') AS s, regexp_split_to_array(lower(trim(translated_text)), '[ \n\t]+') AS t FROM translations WHERE trim(source_text) <> '' AND trim(translated_text) <> ''),
w AS (SELECT unnest(list_zip(s, t)) AS z FROM p WHERE len(s) = len(t)), c AS (SELECT z[1] AS source, z[2] AS target, count(*) AS support FROM w GROUP BY 1, 2),
k AS (SELECT *, support / sum(support) OVER (PARTITION BY source)::DOUBLE AS confidence, max(support) OVER (PARTITION BY source) AS top, count(*) OVER (PARTITION BY source) AS targets FROM c)
SELECT source, target, support, confidence, CASE WHEN targets = 1 THEN 'CONCORDANT' WHEN support = top THEN 'LEADING' ELSE 'CONFLICTING' END AS verdict FROM k""")
def mapping_miner(spark: SparkSession, d: str) -> DataFrame:
    """Words that stand at the same place of a text and its translation, where both have as many: how often each pair occurs, its
    share of all pairs of its source word, and whether others contradict it."""
    t = table(spark, d, "translations").where((F.trim("source_text") != "") & (F.trim("translated_text") != ""))
    cut = lambda c: F.split(F.lower(F.trim(c)), "[ \n\t]+")
    p = t.select(cut("source_text").alias("s"), cut("translated_text").alias("t")).where(F.size("s") == F.size("t"))
    c = p.select(F.explode(F.arrays_zip("s", "t")).alias("z")).groupBy(F.col("z.s").alias("source"), F.col("z.t").alias("target")).agg(F.count(F.lit(1)).alias("support"))
    w = Window.partitionBy("source")
    c = c.withColumn("confidence", F.col("support") / F.sum("support").over(w)).withColumn("top", F.max("support").over(w)).withColumn("targets", F.count(F.lit(1)).over(w))
    return c.select("source", "target", "support", "confidence", F.when(F.col("targets") == 1, "CONCORDANT").when(F.col("support") == F.col("top"), "LEADING").otherwise("CONFLICTING").alias("verdict"))


_PAN, _IFSC = "^[A-Z0-9]{10}$", "^[A-Z0-9]{11}$"
_NUMERIC = r"^[0-9OoIlSB]*[0-9][0-9OoIlSB]*([.,/-][0-9OoIlSB]+)+$"
#: What scanners take digits for.
_MISREAD = ("OoIlSB", "001158")


@R.add(f"""WITH t AS (SELECT span_id, string_split(trim(text), ' ') AS ws FROM text_spans)
SELECT span_id, array_to_string(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '{_NUMERIC}') THEN translate(w, '{_MISREAD[0]}', '{_MISREAD[1]}')
  WHEN regexp_matches(w, '{_PAN}') AND regexp_matches(translate(left(w, 5), '01582', 'OISBZ') || translate(substr(w, 6, 4), 'OILSBZ', '011582') || translate(right(w, 1), '01582', 'OISBZ'), '^[A-Z]{{3}}[ABCFGHJLPT][A-Z][0-9]{{4}}[A-Z]$')
    THEN translate(left(w, 5), '01582', 'OISBZ') || translate(substr(w, 6, 4), 'OILSBZ', '011582') || translate(right(w, 1), '01582', 'OISBZ')
  WHEN regexp_matches(w, '{_IFSC}') AND regexp_matches(translate(left(w, 4), '01582', 'OISBZ') || CASE WHEN regexp_matches(substr(w, 5, 1), '[1-9]') THEN substr(w, 5, 1) ELSE '0' END || substr(w, 6, 6), '^[A-Z]{{4}}0[A-Z0-9]{{6}}$')
    THEN translate(left(w, 4), '01582', 'OISBZ') || '0' || substr(w, 6, 6) ELSE w END), ' ') AS repaired FROM t""")
def critical_repair(spark: SparkSession, d: str) -> DataFrame:
    """Words of spans repaired by their kind: amounts, dates and other numbers with separators, tax numbers and routing codes, the
    latter two only where the result is a valid one."""

    def fix(w):
        pan, ifsc = identifiers.repair_pan(w), identifiers.repair_ifsc(w)
        return (
            F.when(w.rlike(_NUMERIC), F.translate(w, *_MISREAD)).when(w.rlike(_PAN) & identifiers.verify_pan(pan), pan)
            .when(w.rlike(_IFSC) & identifiers.verify_ifsc(ifsc), ifsc).otherwise(w)
        )

    return table(spark, d, "text_spans").select("span_id", F.array_join(F.transform(F.split(F.trim("text"), " "), fix), " ").alias("repaired"))


_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}"
_RATE = r"([0-9]+(?:[.][0-9]+)?) ?%"


@R.add(f"""WITH t AS (SELECT span_id, text, nullif(regexp_extract(text, '({_DAY})', 1), '') AS day, nullif(regexp_extract(text, '{_RATE}', 1), '') AS rate, nullif(regexp_extract(text, '(?:^|[^A-Z0-9])([A-Z]{{5}}[0-9]{{4}}[A-Z])(?:[^A-Z0-9]|$)', 1), '') AS pan, nullif(regexp_extract(text, '(?:^|[^A-Z0-9])([A-Z]{{4}}0[A-Z0-9]{{6}})(?:[^A-Z0-9]|$)', 1), '') AS ifsc FROM text_spans)
SELECT span_id, CASE WHEN pan IS NOT NULL THEN CASE WHEN regexp_matches(pan, '^[A-Z]{{3}}[ABCFGHJLPT]') THEN 'PAN_VALID' ELSE 'PAN_INVALID' END WHEN ifsc IS NOT NULL THEN 'IFSC_VALID'
WHEN day IS NOT NULL THEN CASE WHEN {cells_sql.day('day')} IS NOT NULL THEN 'DATE_VALID' ELSE 'DATE_INVALID' END WHEN rate IS NOT NULL THEN CASE WHEN CAST(rate AS DOUBLE) <= 100 THEN 'RATE_VALID' ELSE 'RATE_INVALID' END ELSE 'UNVERIFIED' END AS verdict FROM t""")
def critical_validate(spark: SparkSession, d: str) -> DataFrame:
    """Whether what a span holds can be: tax numbers, routing codes, days and rates."""
    one = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    pan, ifsc, day, rate = one("(?:^|[^A-Z0-9])([A-Z]{5}[0-9]{4}[A-Z])(?:[^A-Z0-9]|$)"), one("(?:^|[^A-Z0-9])([A-Z]{4}0[A-Z0-9]{6})(?:[^A-Z0-9]|$)"), one(f"({_DAY})"), one(_RATE)
    plain = F.regexp_replace(day, "[-.]", "/")
    real = F.coalesce(F.try_to_date(day, "yyyy-MM-dd"), F.try_to_date(plain, "d/M/yyyy"))
    verdict = (
        F.when(pan.isNotNull(), F.when(identifiers.verify_pan(pan), "PAN_VALID").otherwise("PAN_INVALID")).when(ifsc.isNotNull(), "IFSC_VALID")
        .when(day.isNotNull(), F.when(real.isNotNull(), "DATE_VALID").otherwise("DATE_INVALID")).when(rate.isNotNull(), F.when(rate.try_cast("double") <= 100, "RATE_VALID").otherwise("RATE_INVALID")).otherwise("UNVERIFIED")
    )
    return table(spark, d, "text_spans").select("span_id", verdict.alias("verdict"))


#: Codes that tell of the machinery, not of a document.
OPERATIONAL = ("view", "click")


@R.add(f"""SELECT event_id, CASE WHEN value < 1 THEN upper(event_type) || '_FAILED' ELSE upper(event_type) END AS code FROM events WHERE NOT (CASE WHEN json_extract_string(props, '$.k')::INT % 2 = 0 THEN event_type IN {OPERATIONAL} ELSE
event_type IN {OPERATIONAL} OR regexp_matches(CASE WHEN value < 1 THEN upper(event_type) || '_FAILED' ELSE upper(event_type) END, '(_UNAVAILABLE|_FAILED|_DEGRADED|_SKIPPED|_MISMATCH)$') END)""")
def reviewable_warning(spark: SparkSession, d: str) -> DataFrame:
    """Warnings about documents: codes and suffixes of the machinery are left out, unless the context says that it isn't."""
    code = F.when(F.col("value") < 1, F.concat(F.upper("event_type"), F.lit("_FAILED"))).otherwise(F.upper("event_type"))
    of_document = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    listed = F.col("event_type").isin(*OPERATIONAL)
    machinery = listed | code.rlike("(_UNAVAILABLE|_FAILED|_DEGRADED|_SKIPPED|_MISMATCH)$")
    return table(spark, d, "events").where(~F.when(of_document, listed).otherwise(machinery)).select("event_id", code.alias("code"))
