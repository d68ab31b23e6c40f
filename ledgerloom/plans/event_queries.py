"""Telemetry roll-ups over ``events`` and ``lineitem``, tables in texts, streams in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import rows, telemetry
from ledgerloom.plans.registry import Registry
from ledgerloom.session import table
from ledgerloom.sources import files, tables
from ledgerloom.streaming import events as streams

R = Registry()


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@R.add("SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS calls FROM events GROUP BY 1")
def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    x = events(spark, d).withColumn("value", F.col("value").cast("decimal(18,4)"))
    return telemetry.stage_timings(x, "event_type", "value").withColumn("total", F.col("total").cast("double"))


@R.add("""WITH r AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(n) AS n, CAST(floor(avg(l_quantity)) AS BIGINT) AS mean, max(CASE WHEN k = least(CAST(floor(0.95 * n) AS BIGINT) + 1, n) THEN l_quantity END) AS p95 FROM r GROUP BY 1""")
def device_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    p95 = telemetry.nearest_rank_by(x, ["l_returnflag"], "l_quantity", 0.95).withColumnRenamed("l_quantity", "p95")
    return x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("l_quantity")).alias("mean")).join(p95, "l_returnflag")


@R.add("""SELECT 'cpu-worker-' || CAST(user_id AS VARCHAR) AS worker, count(*) AS tasks, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total_ms, count(*) / CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS per_ms FROM events WHERE value > 0 GROUP BY user_id""")
def worker_performance(spark: SparkSession, d: str) -> DataFrame:
    x = events(spark, d).where("value > 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("tasks"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total_ms"))
    return x.select(F.concat(F.lit("cpu-worker-"), F.col("user_id").cast("string")).alias("worker"), "tasks", "total_ms", (F.col("tasks") / F.col("total_ms")).alias("per_ms"))


@R.add("SELECT count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence >= 0.75 AND confidence < 0.9) AS good, count(*) FILTER (confidence >= 0.5 AND confidence < 0.75) AS fair, count(*) FILTER (confidence < 0.5) AS low FROM text_spans WHERE confidence IS NOT NULL")
def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.confidence_histogram(table(spark, d, "text_spans"), "confidence")


@R.add("SELECT doc_id, page_number, round(arg_max(confidence, span_id), 4) AS confidence FROM text_spans WHERE confidence IS NOT NULL GROUP BY 1, 2")
def page_confidence(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "text_spans").where("confidence is not null")
    return x.groupBy("doc_id", "page_number").agg(F.round(F.max_by("confidence", "span_id"), 4).alias("confidence"))


@R.add("""WITH l AS (SELECT span_id, doc_id, CASE WHEN script IS NULL THEN 'page' ELSE 'span' END AS level FROM text_spans), p AS (SELECT *, max(CASE WHEN level = 'page' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS any_page FROM l) SELECT span_id, level FROM p WHERE any_page = 0 OR level = 'page'""")
def aggregate_confidence_select(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "text_spans").select("span_id", "doc_id", F.when(F.col("script").isNull(), "page").otherwise("span").alias("level"))
    return telemetry.select_page_level(x, ["doc_id"], "level").select("span_id", "level")


@R.add("SELECT language, count(*) AS n, min(confidence) AS low, max(confidence) AS high, round(avg(confidence), 4) AS mean FROM text_spans WHERE confidence IS NOT NULL GROUP BY 1")
def confidence_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_spans").where("confidence is not null").groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.round(F.avg("confidence"), 4).alias("mean")
    )


@R.add("""WITH a AS (SELECT event_type, count(*) AS x FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, count(*) AS y FROM events WHERE user_id % 2 = 1 AND event_type <> 'view' GROUP BY 1)
SELECT coalesce(a.event_type, b.event_type) AS stage, coalesce(x, 0) AS left_run, coalesce(y, 0) AS right_run, coalesce(y, 0) - coalesce(x, 0) AS delta FROM a FULL JOIN b ON a.event_type = b.event_type""")
def run_compare(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    a = e.where("user_id % 2 = 0").groupBy("event_type").agg(F.count(F.lit(1)).alias("x"))
    b = e.where("user_id % 2 = 1 and event_type <> 'view'").groupBy("event_type").agg(F.count(F.lit(1)).alias("y"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, "event_type", "full_outer").select(F.col("event_type").alias("stage"), zero("x").alias("left_run"), zero("y").alias("right_run"), (zero("y") - zero("x")).alias("delta"))


@R.add("WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id FROM r WHERE k = 1 ORDER BY ts DESC, user_id LIMIT 50")
def run_history_upsert(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.keep_newest(events(spark, d).select("user_id", "ts", "event_id"), "user_id", "ts", 50).select("user_id", "event_id")


@R.add("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def history_topn(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id")


@R.add("""WITH k AS (SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderdate DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM orders) SELECT o_orderkey FROM k WHERE kept > 100000""")
def lru_evict(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return telemetry.evict(x, "o_custkey", "o_orderdate", "o_orderkey", 100_000).select("o_orderkey")


@R.add("""SELECT e.event_id, coalesce(CAST(e.user_id AS VARCHAR), s.device) AS device FROM events e LEFT JOIN (SELECT event_type, max(CAST(user_id AS VARCHAR)) AS device FROM events GROUP BY 1) s USING (event_type)""")
def join_span_device(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    s = e.groupBy("event_type").agg(F.max(F.col("user_id").cast("string")).alias("device"))
    return e.join(s, "event_type", "left").select("event_id", F.coalesce(F.col("user_id").cast("string"), "device").alias("device"))


@R.add("SELECT DISTINCT event_type, user_id, props FROM events")
def warning_dedup(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_type", "user_id", "props").distinct()


_CODES = ("error", "view")


@R.add("SELECT e.event_id, c.first_id FROM events e JOIN (SELECT md5(event_type || '|' || CAST(user_id AS VARCHAR)) AS key, min(event_id) AS first_id, min(ts) AS born FROM events GROUP BY 1) c ON md5(e.event_type || '|' || CAST(e.user_id AS VARCHAR)) = c.key WHERE e.ts < c.born + INTERVAL 24 HOUR")
def cache_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Hits on entries by digest within their lifetime of a day."""
    e = events(spark, d).withColumn("key", F.md5(F.concat_ws("|", "event_type", F.col("user_id").cast("string"))))
    c = e.groupBy("key").agg(F.min("event_id").alias("first_id"), F.min("ts").alias("born"))
    return e.join(c, "key").where(F.col("ts") < F.col("born") + F.expr("interval 24 hours")).select("event_id", "first_id")


@R.add("SELECT CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY bbox.y1 - bbox.y0) AS DOUBLE) AS median, least(400, greatest(150, round(200 * 32 / percentile_cont(0.5) WITHIN GROUP (ORDER BY bbox.y1 - bbox.y0)))) AS dpi FROM text_spans WHERE bbox IS NOT NULL")
def adaptive_dpi(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "text_spans").where("bbox is not null").select((F.col("bbox.y1") - F.col("bbox.y0")).alias("h"))
    m = F.percentile("h", 0.5)
    return h.agg(m.alias("median"), F.least(F.lit(400.0), F.greatest(F.lit(150.0), F.round(200 * 32 / m))).alias("dpi"))


@R.add("""WITH w AS (SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type FROM events) SELECT start_us, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The event log read as a stream to its end, counted by hour and type."""
    return streams.tumbling_counts(spark, f"{d}/events.parquet")


@R.add("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return streams.distinct_events(spark, f"{d}/events.parquet")


@R.add()
def stream_active_spans(spark: SparkSession, d: str) -> DataFrame:
    return streams.last_state(spark, f"{d}/events.parquet")


@R.add()
def header_row_score(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "column_mappings").groupBy("file_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("column_index", "source_header"))), lambda x: x["source_header"]).alias("cells"))
    return m.select("file_id", rows.header_score(F.col("cells")).alias("score"))


@R.add()
def scan_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Files rebuilt as delimited texts, cut into blocks again."""
    quoted = F.array_join(F.transform("cells", lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))), ",")
    lines = table(spark, d, "raw_records").select("file_id", F.struct("record_id", quoted.alias("line")).alias("x"))
    texts = lines.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda r: r["line"]), "\n").alias("text"))
    return tables.delimited_blocks(texts, "file_id", "text")


@R.add()
def scan_markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    bars = F.concat(F.lit("| field | value |\n|---|---|\n| source | "), F.coalesce("source", F.lit("")), F.lit(" |\n| lang | "), F.coalesce("lang", F.lit("")), F.lit(" |\n\n"), F.coalesce("text", F.lit("")))
    return tables.markdown_tables(table(spark, d, "documents").select("doc_id", bars.alias("text")), "doc_id", "text")


@R.add()
def scan_html_tables(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<html><body><table id='meta'><tr><th>k</th><th>v</th></tr><tr><td>source</td><td>"), F.coalesce("source", F.lit("")), F.lit("</td></tr></table></body></html>"))
    return tables.html_tables(table(spark, d, "documents").select("doc_id", html.alias("html")), "doc_id", "html")


@R.add()
def identify_format(spark: SparkSession, d: str) -> DataFrame:
    """The format of each document's bytes, after marks of several formats were put in front by its source."""
    lead = F.when(F.col("source") == "branch_scan", "%PDF-1.7\n").when(F.col("source") == "mail_inbox", "<html><body>").when(F.col("source") == "tax_portal", '<?xml version="1.0"?>').otherwise("")
    return table(spark, d, "documents").select("doc_id", files.identify(F.encode(F.concat(lead, F.coalesce("text", F.lit(""))), "UTF-8")).alias("format"))


@R.add("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_lineitem(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return x.rollup("l_returnflag", "l_linestatus").agg(dec("l_quantity").alias("sum_qty"), dec("l_extendedprice").alias("sum_base"), F.count(F.lit(1)).alias("n"))


@R.add("""SELECT n_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def account_rollup(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r.where("r_name = 'ASIA'"), F.col("n_regionkey") == r.r_regionkey)
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
