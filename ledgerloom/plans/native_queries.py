"""Queries of text operators in built-in expressions, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import legacy
from ledgerloom.operators import rows
from ledgerloom.plans.registry import Registry
from ledgerloom.session import table

R = Registry()


def _sql(pattern: str) -> str:
    """A pattern of built-in expressions for SQL."""
    return pattern.replace("'", "''")


_CELLS = ("date", "description", "debit", "credit", "balance")


def _kinds_sql() -> str:
    any_of = lambda p: f"len(list_filter(filled, lambda c: regexp_matches(c, '{_sql(p)}')))"
    heads = " + ".join(f"CAST(contains(r, '{h}') AS INTEGER)" for h in rows.HEADERS)
    summary = _sql(rows.SUMMARY.replace("^(", "^ ("))
    return f"""WITH c AS (SELECT row_id, statement_id, list_transform([{', '.join(_CELLS)}], lambda v: trim(coalesce(v, ''))) AS cl FROM statement_rows), t AS (SELECT *, list_filter(cl, lambda v: v <> '') AS filled, lower(array_to_string(cl, ' ')) AS r FROM c),
u AS (SELECT *, {any_of(rows.DATE)} > 0 AS dated, {any_of(rows.MONEY)} AS money, {heads} AS heads, NOT regexp_matches(r, '{rows.ACTION}') AS quiet FROM t),
k AS (SELECT row_id, statement_id, CASE WHEN len(filled) = 0 OR regexp_matches(r, '{rows.NOISE}') OR {any_of('^[*_=.-]+$')} = len(filled) THEN 'NOISE' WHEN quiet AND regexp_matches(r, '{rows.CLOSING}') THEN 'CLOSING'
  WHEN quiet AND regexp_matches(r, '{rows.OPENING}') THEN 'OPENING' WHEN regexp_matches(r, '{rows.EOD}') THEN 'EOD' WHEN dated AND money > 0 THEN 'TRANSACTION' WHEN regexp_matches(' ' || r || ' ', '{summary}') THEN 'SUMMARY'
  WHEN heads >= 2 AND NOT dated THEN 'HEADER' WHEN dated OR money > 0 THEN 'TRANSACTION' WHEN length(r) > 3 THEN 'CONTINUATION' ELSE 'NOISE' END AS kind FROM u)"""


@R.add(_kinds_sql() + " SELECT row_id, kind FROM k")
def row_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statement_rows").select("row_id", rows.row_kind(F.array(*_CELLS)).alias("kind"))


@R.add(_kinds_sql() + """, n AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY row_id) AS i FROM k),
s AS (SELECT statement_id, avg(CASE WHEN kind = 'TRANSACTION' THEN 1.0 ELSE 0.0 END) AS tx, count(*) FILTER (kind IN ('SUMMARY', 'OPENING', 'CLOSING', 'EOD')) AS sums, count(*) FILTER (kind IN ('CONTINUATION', 'HEADER')) AS texts, count(*) AS m FROM n WHERE i <= 10 GROUP BY 1)
SELECT statement_id, CASE WHEN tx >= 0.3 THEN 'TRANSACTION' WHEN sums * 2 >= m THEN 'SUMMARY' WHEN texts * 2 >= m THEN 'METADATA' ELSE 'UNRELATED' END AS table_kind FROM s""")
def table_classify(spark: SparkSession, d: str) -> DataFrame:
    """What a statement's table is, by its first ten rows: three tenths transactions, else half sums, else half texts. The ten
    rows are smallest ids that are kept by partial aggregation, so that no table is sorted."""
    first = table(spark, d, "statement_rows").select("statement_id", "row_id", rows.row_kind(F.array(*_CELLS)).alias("kind"))
    top = rows.smallest(first, ["statement_id"], "row_id", 10)
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    s = top.groupBy("statement_id").agg(n("TRANSACTION").alias("tx"), n("SUMMARY", "OPENING", "CLOSING", "EOD").alias("sums"), n("CONTINUATION", "HEADER").alias("texts"), F.count(F.lit(1)).alias("m"))
    kind = F.when(F.col("tx") * 10 >= F.col("m") * 3, "TRANSACTION").when(F.col("sums") * 2 >= F.col("m"), "SUMMARY").when(F.col("texts") * 2 >= F.col("m"), "METADATA").otherwise("UNRELATED")
    return s.select("statement_id", kind.alias("table_kind"))


_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n]+'), lambda w: w <> '')"


@R.add(rf"""WITH t AS (SELECT detection_id, {_WORDS.format('lower(bank_name)')} AS x, {_WORDS.format('bank_name')} AS y FROM detections WHERE trim(bank_name) <> '')
SELECT detection_id, CAST(list_aggregate(list_transform(list_zip(x, y), lambda z: CASE WHEN z[1] = z[2] THEN 0 ELSE 1 END), 'sum') AS DOUBLE) / len(x) AS wer FROM t""")
def wer(spark: SparkSession, d: str) -> DataFrame:
    """Words of typed names that differ from their form in small letters, per word: the edit distance of the words, each of which
    stands as one character. (Both have as many words, so SQL counts those that differ.)"""
    words = lambda c: F.filter(F.split(c, "[ \t\n]+"), lambda w: w != "")
    t = table(spark, d, "detections").where(F.trim("bank_name") != "").select("detection_id", words(F.lower("bank_name")).alias("x"), words(F.col("bank_name")).alias("y"))
    t = t.withColumn("abc", F.array_distinct(F.concat("x", "y")))
    coded = lambda c: F.array_join(F.transform(c, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position("abc", w) + 0x4E00), 4, "0")), "UTF-16BE")), "")
    return t.select("detection_id", (F.levenshtein(coded("x"), coded("y")) / F.size("x")).alias("wer"))


_TITLE = r"(?:Shri|Smt|Mr|Mrs|Ms|Dr|Prof|Justice|Advocate|श्री|श्रीमती|डॉ)\.? +"
_NAME = r"((?:[A-Z][A-Za-z'-]+|[\x{0900}-\x{0963}\x{0970}-\x{097F}]+)(?: +[A-Z][A-Za-z'-]+)*)"


@R.add(rf"""SELECT doc_id, unnest(regexp_extract_all(text, '{_sql(_TITLE + _NAME)}', 1)) AS name FROM documents""")
def proper_noun_guard(spark: SparkSession, d: str) -> DataFrame:
    """Names that follow a title, which a rewrite has to keep."""
    return table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_TITLE + _NAME), F.lit(1))).alias("name"))


#: Terms and what they become, longest first.
_TERMS = (("savings account", "बचत खाता"), ("cheque book", "चेक बुक"), ("statement", "विवरण"), ("account", "खाता"), ("balance", "शेष"), ("branch", "शाखा"), ("cheque", "चेक"), ("tax", "कर"))


def _glossary_sql() -> tuple[str, str]:
    x, n = "text", []
    for a, b in _TERMS:
        p = rf"(^|[^A-Za-z0-9_]){a}([^A-Za-z0-9_]|$)"
        n.append(f"len(regexp_extract_all({x}, '{p}'))")
        x = f"regexp_replace({x}, '{p}', '\\1{b}\\2', 'g')"
    return x, " + ".join(n)


@R.add(f"SELECT doc_id, md5({_glossary_sql()[0]}) AS digest, {_glossary_sql()[1]} AS terms FROM documents WHERE text IS NOT NULL")
def glossary_apply(spark: SparkSession, d: str) -> DataFrame:
    """Texts with the terms of a glossary replaced, whole words only, longer terms first, and how many were."""
    x, n = F.col("text"), F.lit(0)
    for a, b in _TERMS:
        p = rf"(^|[^A-Za-z0-9_]){a}([^A-Za-z0-9_]|$)"
        n = n + F.size(F.regexp_extract_all(x, F.lit(f"({p})"), F.lit(1)))
        x = F.regexp_replace(x, p, f"$1{b}$2")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(x).alias("digest"), n.cast("long").alias("terms"))


_C = legacy.CONSONANT


@R.add(f"""WITH t AS (SELECT span_id, text, regexp_replace(text, '((?:{_C}्)*{_C})ि', chr(57344) || '\\1', 'g') AS typed FROM text_spans)
SELECT span_id, md5(typed) AS typed, regexp_replace(typed, chr(57344) || '((?:{_C}्)*{_C})', '\\1ि', 'g') AS text FROM t""")
def prebase_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Vowel signs as old layouts type them, before their consonants, put behind them again."""
    typed = F.regexp_replace("text", f"((?:{_C}्)*{_C})ि", "$1")
    return table(spark, d, "text_spans").select("span_id", F.md5(typed).alias("typed"), legacy.prebase_column(typed).alias("text"))


@R.add(f"""WITH t AS (SELECT span_id, regexp_replace(text, 'र्((?:{_C}्)*{_C}[ा-ौंँः]*)', '\\1' || chr(57345), 'g') AS typed FROM text_spans)
SELECT span_id, md5(typed) AS typed, regexp_replace(typed, '((?:{_C}्)*{_C}[ा-ौंँः]*)' || chr(57345), 'र्\\1', 'g') AS text FROM t""")
def reph_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Rephas as old layouts type them, behind their syllable, put before it again."""
    typed = F.regexp_replace("text", f"र्((?:{_C}्)*{_C}[ा-ौंँः]*)", "$1")
    return table(spark, d, "text_spans").select("span_id", F.md5(typed).alias("typed"), legacy.repha_column(typed).alias("text"))
