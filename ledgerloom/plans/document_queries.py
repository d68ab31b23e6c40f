"""Queries over documents, their spans, layouts and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import formats, text
from ledgerloom.operators import bank_registry, layout, ledger
from ledgerloom.plans.registry import Registry
from ledgerloom.session import table
from ledgerloom.streaming import events as streams

R = Registry()
PAGE = ["doc_id", "page_number"]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def grid(spark: SparkSession, d: str) -> DataFrame:
    return layout.on_grid(table(spark, d, "text_spans"), PAGE, "span_id", "text", "bbox")


def _island(name: str, start: str, end: str, gap: str, source: str) -> str:
    w = f"PARTITION BY doc_id, page_number ORDER BY {start}, span_id"
    return (
        f"{name}_a AS (SELECT *, CASE WHEN {start} - max({end}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {gap} THEN 1 ELSE 0 END AS {name}_new FROM {source}), "
        f"{name} AS (SELECT *, CAST(sum({name}_new) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS {name}_no FROM {name}_a)"
    )


_GRID = (
    "WITH f AS (SELECT doc_id, page_number, span_id, text AS t, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM text_spans WHERE bbox IS NOT NULL), "
    "hh AS (SELECT *, quantile_cont(y1 - y0, 0.5) OVER (PARTITION BY doc_id, page_number) AS h FROM f), "
    + _island("col", "x0", "x1", "greatest(15.0, h * 0.75)", "hh") + ", " + _island("row", "y0", "y1", "0.0", "col") + ", " + _island("par", "y0", "y1", "h * 0.75", "row")
)
_TEXT = "coalesce(string_agg(CASE WHEN trim(t) <> '' THEN trim(t) END, ' ' ORDER BY {}), '')"


@R.add(_GRID + " SELECT doc_id, page_number, col_no, min(x0) AS x0, max(x1) AS x1, count(*) AS spans FROM par GROUP BY 1, 2, 3")
def detect_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of each page, between gutters that run down the whole page."""
    return layout.page_columns(grid(spark, d), PAGE)


@R.add(_GRID + f" SELECT doc_id, page_number, par_no, count(*) AS spans, {_TEXT.format('row_no, x0, span_id')} AS paragraph FROM par GROUP BY 1, 2, 3")
def group_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return layout.paragraphs(grid(spark, d), PAGE, "span_id")


_CELLS = _GRID + f", cells AS (SELECT doc_id, page_number, row_no, col_no, {_TEXT.format('x0, span_id')} AS cell FROM par GROUP BY 1, 2, 3, 4)"


@R.add(_CELLS + " SELECT * FROM cells")
def reconstruct_table(spark: SparkSession, d: str) -> DataFrame:
    """The table that lines and columns of each page make."""
    return layout.table_cells(grid(spark, d), PAGE, "span_id")


@R.add(_CELLS + """, g AS (SELECT doc_id, page_number, count(DISTINCT row_no) AS rows, count(DISTINCT col_no) AS columns, count(*) FILTER (cell <> '') AS filled FROM cells GROUP BY 1, 2)
SELECT * FROM g WHERE rows >= 2 AND columns >= 2 AND filled >= 0.6 * rows * columns""")
def table_grids(spark: SparkSession, d: str) -> DataFrame:
    return layout.table_grids(layout.table_cells(grid(spark, d), PAGE, "span_id"), PAGE)


@R.add(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM l),
c AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_split_to_array(trim(line), ' {2,}|\t|: ') AS cells FROM n WHERE trim(line) <> '') SELECT doc_id, line_no, len(cells) AS columns, array_to_string(cells, '|') AS cells FROM c WHERE len(cells) >= 2""")
def reconstruct_fixed_columns(spark: SparkSession, d: str) -> DataFrame:
    """Lines of texts that blanks, tabs or labels cut into columns."""
    x = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    cells = F.split(F.trim("line"), r" {2,}|\t|: ")
    return x.select("doc_id", "line_no", F.size(cells).cast("long").alias("columns"), F.array_join(cells, "|").alias("cells")).where("columns >= 2")


_MONEY = text.CRITICAL[0][1]


@R.add(f"""WITH r AS (SELECT doc_id, page_number, min(bbox.x0) AS rx0, min(bbox.y0) AS ry0, max(bbox.x1) AS rx1, max(bbox.y1) AS ry1 FROM text_spans WHERE bbox IS NOT NULL AND regexp_matches(trim(text), '{_MONEY}') GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT span_id FROM text_spans s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = s.doc_id AND r.page_number = s.page_number AND (s.bbox.x0 + s.bbox.x1) / 2 BETWEEN rx0 - 3 AND rx1 + 3 AND (s.bbox.y0 + s.bbox.y1) / 2 BETWEEN ry0 - 3 AND ry1 + 3)""")
def anti_consumed_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans that no table takes: tables are where the amounts of a page stand."""
    s = table(spark, d, "text_spans")
    b = F.col("bbox")
    amounts = s.where(b.isNotNull() & F.trim("text").rlike(_MONEY)).groupBy(*PAGE)
    regions = amounts.agg(F.min(b["x0"]).alias("rx0"), F.min(b["y0"]).alias("ry0"), F.max(b["x1"]).alias("rx1"), F.max(b["y1"]).alias("ry1"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    return s.select("span_id").join(layout.inside(s, regions, PAGE, "bbox").select("span_id"), "span_id", "left_anti")


@R.add(r"""SELECT span_id, bbox IS NOT NULL AND bbox.x1 > bbox.x0 AND bbox.y1 > bbox.y0 AS box_ok, coalesce(confidence BETWEEN 0 AND 1, FALSE) AS confidence_ok, coalesce(trim(text) <> '', FALSE) AS text_ok FROM text_spans""")
def ocr_output_parse(spark: SparkSession, d: str) -> DataFrame:
    """What a reader gave back, checked: boxes, confidences, texts."""
    b, yes = F.col("bbox"), lambda c: F.coalesce(c, F.lit(False))
    return table(spark, d, "text_spans").select(
        "span_id", yes(b.isNotNull() & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])).alias("box_ok"), yes(F.col("confidence").between(0, 1)).alias("confidence_ok"), yes(F.trim("text") != "").alias("text_ok")
    )


@R.add("""WITH s AS (SELECT doc_id, count(*) AS spans, md5(string_agg(translate(coalesce(text, ''), '०१२३४५६७८९', '0123456789'), chr(10) ORDER BY span_id)) AS span_digest FROM text_spans GROUP BY 1)
SELECT d.doc_id, md5(translate(d.text, '०१२३४५६७८९', '0123456789')) AS text_digest, coalesce(s.spans, 0) AS spans, s.span_digest FROM documents d LEFT JOIN s USING (doc_id)""")
def canonical_transform(spark: SparkSession, d: str) -> DataFrame:
    """A function over the text and all spans of each document."""
    part = F.struct("span_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = table(spark, d, "text_spans").groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("spans"))
    nested = docs(spark, d).select("doc_id", "text").join(spans, "doc_id", "left")
    done = nested.withColumn("text", text.ascii_numerals(F.col("text"))).withColumn("spans", F.transform("spans", lambda s: s.withField("text", text.ascii_numerals(s["text"]))))
    return done.select("doc_id", F.md5("text").alias("text_digest"), F.coalesce(F.size(F.coalesce("spans", F.array())), F.lit(0)).cast("long").alias("spans"), F.md5(F.array_join(F.transform("spans", lambda s: s["text"]), "\n")).alias("span_digest"))


@R.add("""SELECT coalesce(document_id, 'doc') || '_' || CAST(doc_id AS VARCHAR) || '.txt' AS artifact, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS bytes, coalesce(source_input_id, 'unknown') AS input, 'documents' AS stage,
array_to_string(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'EMPTY_TEXT' END, CASE WHEN source_input_id IS NULL THEN 'UNKNOWN_INPUT' END, CASE WHEN detected_type IS NULL THEN 'UNKNOWN_TYPE' END], lambda x: x IS NOT NULL), ',') AS warnings FROM documents""")
def sink_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of a run: each artifact with its digest, size, provenance and the codes of its warnings."""
    x = F.coalesce("text", F.lit(""))
    codes = F.array_compact(F.array(F.when(F.trim(x) == "", "EMPTY_TEXT"), F.when(F.col("source_input_id").isNull(), "UNKNOWN_INPUT"), F.when(F.col("detected_type").isNull(), "UNKNOWN_TYPE")))
    return docs(spark, d).select(
        F.concat(F.coalesce("document_id", F.lit("doc")), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("artifact"), F.sha2(x, 256).alias("sha256"), F.octet_length(x).cast("long").alias("bytes"),
        F.coalesce("source_input_id", F.lit("unknown")).alias("input"), F.lit("documents").alias("stage"), F.array_join(codes, ",").alias("warnings"),
    )


#: Codes of issues by severity, and those whose context tells one from another.
_SEVERE, _CONTEXT = ("MISSING_BOUNDARIES", "PERIOD_REVERSED"), ("MISSING_CLOSING", "PERIOD_REVERSED")
_ISSUES = """WITH i AS (SELECT account_key, statement_id, unnest(list_filter([CASE WHEN opening_balance IS NULL AND closing_balance IS NULL THEN 'MISSING_BOUNDARIES' END, CASE WHEN closing_balance IS NULL THEN 'MISSING_CLOSING' END,
  CASE WHEN period_end < period_start THEN 'PERIOD_REVERSED' END, CASE WHEN source_tz IS NULL THEN 'UNKNOWN_ZONE' END, CASE WHEN date_order IS NULL THEN 'UNKNOWN_ORDER' END], lambda x: x IS NOT NULL)) AS code FROM statements)"""


@R.add(_ISSUES + f"""SELECT a.account_key, coalesce(n, 0) AS issues, coalesce(raised, 0) AS raised, CASE WHEN bad > 0 THEN 'INVALID' WHEN n > 0 THEN 'WARNING' ELSE 'VALID' END AS status FROM (SELECT DISTINCT account_key FROM statements) a LEFT JOIN
(SELECT account_key, count(DISTINCT code || CASE WHEN code IN {_CONTEXT} THEN '|' || statement_id ELSE '' END) AS n, count(*) AS raised, count(*) FILTER (code IN {_SEVERE}) AS bad FROM i GROUP BY 1) s ON s.account_key IS NOT DISTINCT FROM a.account_key""")
def issue_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Issues of an account, each once (some once for each statement), and the status that they lead to."""
    s = table(spark, d, "statements")
    codes = F.array_compact(
        F.array(
            F.when(F.col("opening_balance").isNull() & F.col("closing_balance").isNull(), "MISSING_BOUNDARIES"), F.when(F.col("closing_balance").isNull(), "MISSING_CLOSING"),
            F.when(F.col("period_end") < F.col("period_start"), "PERIOD_REVERSED"), F.when(F.col("source_tz").isNull(), "UNKNOWN_ZONE"), F.when(F.col("date_order").isNull(), "UNKNOWN_ORDER"),
        )
    )
    i = s.select("account_key", "statement_id", F.explode_outer(codes).alias("code"))
    key = F.when(F.col("code").isin(*_CONTEXT), F.concat_ws("|", "code", "statement_id")).otherwise(F.col("code"))
    x = i.groupBy("account_key").agg(F.count_distinct(key).alias("issues"), F.count("code").alias("raised"), F.count_if(F.col("code").isin(*_SEVERE)).alias("bad"))
    return x.select("account_key", "issues", "raised", F.when(F.col("bad") > 0, "INVALID").when(F.col("issues") > 0, "WARNING").otherwise("VALID").alias("status"))


@R.add("""WITH t AS (SELECT source_input_id, account_key, count(*) FILTER (coalesce(debit, credit) IS NOT NULL) AS n FROM transactions WHERE source_input_id IS NOT NULL GROUP BY 1, 2),
s AS (SELECT account_key, count(*) AS statements, count(*) FILTER (status = 'INVALID') AS invalid FROM statements GROUP BY 1),
j AS (SELECT source_input_id, sum(n) AS transactions, sum(coalesce(statements, 0)) AS statements, sum(coalesce(invalid, 0)) AS invalid FROM t LEFT JOIN s USING (account_key) GROUP BY 1)
SELECT x.source_input_id, CAST(coalesce(transactions, 0) AS BIGINT) AS transactions, CAST(coalesce(statements, 0) AS BIGINT) AS statements, CASE WHEN coalesce(statements, 0) = 0 OR invalid > 0 OR transactions = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS outcome
FROM (SELECT DISTINCT source_input_id FROM documents WHERE source_input_id IS NOT NULL) x LEFT JOIN j USING (source_input_id)""")
def join_provenance_docs(spark: SparkSession, d: str) -> DataFrame:
    """Each input document with its transactions and statements, and the outcome."""
    t = table(spark, d, "transactions").where("source_input_id is not null").groupBy("source_input_id", "account_key").agg(F.count_if(F.coalesce("debit", "credit").isNotNull()).alias("n"))
    s = table(spark, d, "statements").groupBy("account_key").agg(F.count(F.lit(1)).alias("statements"), F.count_if(F.col("status") == "INVALID").alias("invalid"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = t.join(s, "account_key", "left").groupBy("source_input_id").agg(F.sum("n").alias("transactions"), F.sum(zero("statements")).alias("statements"), F.sum(zero("invalid")).alias("invalid"))
    x = docs(spark, d).where("source_input_id is not null").select("source_input_id").distinct().join(j, "source_input_id", "left")
    failed = (zero("statements") == 0) | (zero("invalid") > 0) | (zero("transactions") == 0)
    return x.select("source_input_id", zero("transactions").alias("transactions"), zero("statements").alias("statements"), F.when(failed, "FAILED").otherwise("SUCCESS").alias("outcome"))


@R.add("""WITH p AS (SELECT statement_id, page_number, md5(string_agg(coalesce(description, ''), '|' ORDER BY row_index, row_id)) AS digest, count(*) AS rows FROM statement_rows GROUP BY 1, 2),
w AS (SELECT statement_id, md5(string_agg(coalesce(description, ''), '|' ORDER BY page_number, row_index, row_id)) AS digest, count(*) AS rows FROM statement_rows GROUP BY 1)
SELECT statement_id, page_number, digest, rows FROM p UNION ALL SELECT statement_id, NULL, digest, rows FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.statement_id = w.statement_id AND p.digest = w.digest)""")
def union_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of pages, and those of whole documents that no page holds already."""
    r = table(spark, d, "statement_rows").withColumn("x", F.coalesce("description", F.lit("")))
    of = lambda *order: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "x"))), lambda p: p["x"]), "|")).alias("digest")
    pages = r.groupBy("statement_id", "page_number").agg(of("row_index", "row_id"), F.count(F.lit(1)).alias("rows"))
    whole = r.groupBy("statement_id").agg(of("page_number", "row_index", "row_id"), F.count(F.lit(1)).alias("rows"))
    more = whole.join(pages.select("statement_id", "digest"), ["statement_id", "digest"], "left_anti")
    return pages.unionByName(more.withColumn("page_number", F.lit(None).cast("int")))


_SECRET = r"(?i)((password|passwd|secret|token|api[_-]?key|bearer|otp|pin code) *[:=] *)[^ \n\t,;]+"


@R.add(rf"""SELECT doc_id, md5(regexp_replace(text, '{_SECRET}', '\1[redacted]', 'g')) AS digest FROM documents""")
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts without the values of secrets."""
    return docs(spark, d).select("doc_id", F.md5(formats.redact(F.col("text"), _SECRET)).alias("digest"))


def _tenths(c: str, unit: int, name: str) -> str:
    t = f"(({c}) * 10 + {unit // 2}) // {unit}"
    return f"CAST(({t}) // 10 AS VARCHAR) || '.' || CAST(({t}) % 10 AS VARCHAR) || ' {name}'"


@R.add(f"""SELECT doc_id, CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B' WHEN n_chars < 1048576 THEN {_tenths('n_chars', 1024, 'KB')} ELSE {_tenths('n_chars', 1048576, 'MB')} END AS size,
CASE WHEN n_chars < 1000 THEN CAST(n_chars AS VARCHAR) || ' us' ELSE {_tenths('n_chars * 1000', 1000000, 'ms')} END AS took FROM documents WHERE n_chars IS NOT NULL""")
def format_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and durations as they are shown."""
    return docs(spark, d).where("n_chars is not null").select("doc_id", formats.size(F.col("n_chars")).alias("size"), formats.duration(F.col("n_chars") * 1000).alias("took"))


@R.add(r"""SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN starts_with(ltrim(text), '{\rtf') THEN 'rtf' WHEN regexp_matches(lower(left(ltrim(text), 200)), '^<(!doctype html|html|body)') THEN 'html' WHEN starts_with(ltrim(text), '<?xml') THEN 'xml'
WHEN len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]')) > 0.2 * length(text) THEN 'binary' ELSE 'text' END AS format FROM documents""")
def detect_content_format(spark: SparkSession, d: str) -> DataFrame:
    """The second look at a content that was read as text."""
    return docs(spark, d).select("doc_id", formats.content_format(F.col("text")).alias("format"))


_REF = r"(?:Section|Rule|Article|Order) [0-9]+[A-Z]?"


@R.add(rf"""SELECT doc_id, CASE WHEN contains(text, 'Supreme Court') THEN 'Supreme Court' WHEN contains(text, 'High Court') THEN 'High Court' WHEN regexp_matches(text, '(?i)tribunal') THEN 'Tribunal' END AS court,
len(list_distinct(regexp_extract_all(text, '{_REF}'))) AS refs, len(regexp_extract_all(text, '(?i)(petitioner|respondent|appellant|complainant|deponent)')) AS parties FROM documents""")
def legal_context(spark: SparkSession, d: str) -> DataFrame:
    """Court, references and parties of each document."""
    x, n = F.col("text"), lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    court = F.when(x.contains("Supreme Court"), "Supreme Court").when(x.contains("High Court"), "High Court").when(x.rlike("(?i)tribunal"), "Tribunal")
    refs = F.size(F.array_distinct(F.regexp_extract_all(x, F.lit(f"({_REF})"), F.lit(1))))
    return docs(spark, d).select("doc_id", court.alias("court"), F.when(x.isNotNull(), refs).cast("long").alias("refs"), n("(?i)(petitioner|respondent|appellant|complainant|deponent)").alias("parties"))


_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(" + _PLAIN + r", 'co operative', 'cooperative', 'g'), '\b(the|limited|ltd|pvt|private|co|inc)\b', '', 'g'), ' +', ' ', 'g'))"
_SIZES = (10, 8, 6, 4)


@R.add(f"""WITH e AS (SELECT {_PLAIN.format('bank_name')} AS k, min(bank_id) AS bank_id FROM banks_catalog GROUP BY 1), n AS (SELECT {_NORMAL.format('bank_name')} AS n, min(bank_id) AS bank_id FROM banks_catalog GROUP BY 1 HAVING n <> ''),
r AS (SELECT detection_id, {_PLAIN.format('bank_name')} AS k, {_NORMAL.format('bank_name')} AS n, upper(trim(ifsc)) AS c FROM detections),
o AS (SELECT size, left(c, size) AS prefix, bank_id, count(*) AS m FROM r JOIN e USING (k), (VALUES (10), (8), (6), (4)) v(size) WHERE length(c) >= size GROUP BY 1, 2, 3),
p AS (SELECT size, prefix, arg_max(bank_id, struct_pack(m := m, b := -bank_id)) AS bank_id FROM o GROUP BY 1, 2),
j AS (SELECT r.*, {', '.join(f'p{s}.bank_id AS b{s}' for s in _SIZES)}, e.bank_id AS be, n.bank_id AS bn, (SELECT arg_max(q.bank_id, struct_pack(l := length(q.n), m := -q.bank_id)) FROM n q WHERE contains(' ' || r.n || ' ', ' ' || q.n || ' ')) AS bc FROM r
  {' '.join(f'LEFT JOIN p p{s} ON p{s}.size = {s} AND p{s}.prefix = left(r.c, {s}) AND length(r.c) >= {s}' for s in _SIZES)} LEFT JOIN e ON e.k = r.k LEFT JOIN n ON n.n = r.n)
SELECT detection_id, coalesce({', '.join(f'b{s}' for s in _SIZES)}, be, bn, bc) AS bank_id, CASE {' '.join(f"WHEN b{s} IS NOT NULL THEN 'CODE_{s}'" for s in _SIZES)} WHEN be IS NOT NULL THEN 'NAME' WHEN bn IS NOT NULL THEN 'NORMAL_NAME' WHEN bc IS NOT NULL THEN 'CONTAINED' END AS how FROM j""")
def join_bank_registry(spark: SparkSession, d: str) -> DataFrame:
    """Code prefixes from long to short, then names; which prefix is whose is shown by the rows with an exact name."""
    return bank_registry.resolve(table(spark, d, "detections"), table(spark, d, "banks_catalog"), "detection_id", "bank_name", "ifsc")


@R.add("""WITH e AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM
(SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM e GROUP BY user_id, g""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.session_counts(spark, f"{d}/events.parquet")


@R.add("""SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) - k * 1800000000 AS start_us, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of an hour that begin every half hour."""
    return streams.tumbling_counts(spark, f"{d}/events.parquet", width="1 hour", slide="30 minutes")


@R.add("""WITH e AS (SELECT user_id AS run_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS span_id, event_type, epoch_us(ts) AS us FROM events WHERE event_type IN ('view', 'purchase')), n AS (SELECT run_id, max(us) AS now FROM e GROUP BY 1),
s AS (SELECT run_id, span_id, min(CASE WHEN event_type = 'view' THEN us END) AS opened_us, max(CASE WHEN event_type = 'purchase' THEN us END) AS closed_us FROM e GROUP BY 1, 2)
SELECT run_id, span_id, coalesce(opened_us, -1) AS opened_us, coalesce(closed_us, -1) AS closed_us, CASE WHEN opened_us IS NULL THEN 'UNMATCHED' WHEN closed_us IS NOT NULL THEN 'CLOSED' WHEN now - opened_us > 21600000000 THEN 'ORPHANED' ELSE 'OPEN' END AS status FROM s JOIN n USING (run_id)""")
def stream_span_life(spark: SparkSession, d: str) -> DataFrame:
    """Spans that open and close, and those that nobody closed."""
    return streams.span_lives(spark, f"{d}/events.parquet").na.fill(-1, ["opened_us", "closed_us"])


@R.add()
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """The state machine of failing items."""
    return streams.quarantined(spark, f"{d}/events.parquet")


@R.add("""WITH r AS (SELECT event_id, ts, row_number() OVER (ORDER BY CAST(ts AS DATE), ts, event_id) AS k FROM events WHERE event_type = 'error') SELECT event_id, 'W-' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END AS number FROM r""")
def review_index(spark: SparkSession, d: str) -> DataFrame:
    """Warnings to be reviewed, numbered in the order of time."""
    x = table(spark, d, "events").where("event_type = 'error'").withColumn("day", F.to_date("ts"))
    return ledger.renumber(x, ["ts", "event_id"], "day", "number", "W-").select("event_id", "number")


@R.add("""WITH p AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) SELECT event_id, coalesce(epoch_us(ts) - epoch_us(prev), -1) AS elapsed_us, coalesce(epoch_us(ts) - epoch_us(prev) >= 5000000, FALSE) AS long_running FROM p""")
def long_running_rule(spark: SparkSession, d: str) -> DataFrame:
    """Whether five seconds or more went by since the event before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    e = table(spark, d, "events").select("event_id", us(F.col("ts")).alias("us"), us(F.lag("ts").over(w)).alias("prev"))
    return e.select("event_id", F.coalesce(F.col("us") - F.col("prev"), F.lit(-1)).alias("elapsed_us"), F.coalesce(F.col("us") - F.col("prev") >= 5_000_000, F.lit(False)).alias("long_running"))
