"""Ledger queries over ``transactions``, ``statements`` and ``statement_rows``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, identifiers, money
from ledgerloom.operators import ledger
from ledgerloom.plans import cells_sql
from ledgerloom.plans.registry import Registry
from ledgerloom.session import spread, table, written

R = Registry()

#: The ledger in SQL: balances are missing where the mode is, so that expected balances have to be carried.
L = """
WITH l AS (SELECT transaction_id AS seq, account_key, CAST(loaded_at AS DATE) AS day, loaded_at, debit, credit, description, currency, source_input_id,
  CASE WHEN transaction_mode IS NOT NULL THEN CAST(regexp_replace(balance, '[^0-9.\\-]', '', 'g') AS DECIMAL(18,2)) END AS bal,
  coalesce(credit, 0) - coalesce(debit, 0) AS net FROM transactions)"""


def base(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transactions")
    bal = F.regexp_replace("balance", r"[^0-9.\-]", "").try_cast("decimal(18,2)")
    return t.select(
        F.col("transaction_id").alias("seq"), "account_key", F.to_date("loaded_at").alias("day"), "loaded_at", "debit", "credit", "description", "currency",
        "source_input_id", F.when(F.col("transaction_mode").isNotNull(), bal).alias("bal"),
    )


def num(c: str) -> Column:
    return F.col(c).cast("double").alias(c)


@R.add(L + """, a AS (SELECT *, count(bal) OVER w AS grp, last_value(bal IGNORE NULLS) OVER w AS last_own FROM l
  WINDOW w AS (PARTITION BY account_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, last_own + sum(net) OVER (PARTITION BY account_key, grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS expected FROM a)
SELECT seq, account_key, CAST(expected AS DOUBLE) AS expected, coalesce(bal IS NOT NULL AND expected IS NOT NULL AND abs(bal - expected) >= 0.01, FALSE) AS discontinuity FROM b""")
def running_balance_check(spark: SparkSession, d: str) -> DataFrame:
    x = ledger.running_balance_check(base(spark, d), ["account_key"], "seq", "debit", "credit", "bal")
    return x.select("seq", "account_key", num("expected"), "discontinuity")


@R.add(L + """ SELECT seq, coalesce(lead(day) OVER w = day AND abs(lead(bal) OVER w - bal) < 0.01, FALSE) AS exempt FROM l WINDOW w AS (PARTITION BY account_key ORDER BY seq)""")
def repeated_daily_balance_exempt(spark: SparkSession, d: str) -> DataFrame:
    return ledger.repeated_daily_balance(base(spark, d), ["account_key"], "seq", "day", "bal").select("seq", "exempt")


@R.add(L + """ SELECT seq, CAST(last_value(bal) OVER (PARTITION BY account_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  - coalesce(sum(net) OVER (PARTITION BY account_key ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS DOUBLE) AS expected_back FROM l""")
def backward_anchor(spark: SparkSession, d: str) -> DataFrame:
    return ledger.backward_anchor(base(spark, d), ["account_key"], "seq", "debit", "credit", "bal").select("seq", num("expected_back"))


_ORDER = L + """, a AS (SELECT account_key, bal = lag(bal) OVER w + net AS f, bal = lead(bal) OVER w + net AS r, bal = lag(bal) OVER w - net AND net <> 0 AS i,
  lag(bal) OVER w IS NOT NULL AND net <> 0 AS t, day < lag(day) OVER w AS falls, day > lag(day) OVER w AS rises FROM l WINDOW w AS (PARTITION BY account_key ORDER BY seq)),
b AS (SELECT account_key, count(*) FILTER (f) AS forward, count(*) FILTER (r) AS backward, count(*) FILTER (i) AS swapped, count(*) FILTER (t) AS testable,
  count(*) FILTER (falls) AS falling, count(*) FILTER (rises) AS rising FROM a GROUP BY account_key) """


@R.add(_ORDER + "SELECT account_key, forward, backward, backward > forward OR (backward = forward AND falling > 0 AND rising = 0) AS reversed FROM b")
def reverse_order_detect(spark: SparkSession, d: str) -> DataFrame:
    return ledger.order_and_inversion(base(spark, d), ["account_key"], "seq", "day", "debit", "credit", "bal").select("account_key", "forward", "backward", "reversed")


@R.add(_ORDER + "SELECT account_key, swapped, testable, testable >= 2 AND swapped >= 2 AND swapped > forward AND swapped >= 0.75 * testable AS inverted FROM b")
def dr_cr_inversion(spark: SparkSession, d: str) -> DataFrame:
    return ledger.order_and_inversion(base(spark, d), ["account_key"], "seq", "day", "debit", "credit", "bal").select("account_key", "swapped", "testable", "inverted")


#: Statement rows with parsed amounts, in SQL.
_AMOUNT = """CASE WHEN lower(trim({c})) IN ('', '-', '--', 'na', 'n/a', 'nil', 'null') THEN NULL ELSE TRY_CAST(regexp_replace(regexp_replace(trim({c}), '(?i)\\s*(dr|cr)\\.?$', ''), ',', '', 'g') AS DECIMAL(38,2)) END"""
_LINES = f"""WITH s AS (SELECT row_id, statement_id, row_index, page_number, date, description, reference_number,
  {_AMOUNT.format(c='debit')} AS debit, {_AMOUNT.format(c='credit')} AS credit, {_AMOUNT.format(c='balance')} AS bal FROM statement_rows)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "statement_rows")
    return t.select(
        "row_id", "statement_id", "row_index", "page_number", "date", "description", "reference_number",
        money.parse_decimal(F.col("debit")).alias("debit"), money.parse_decimal(F.col("credit")).alias("credit"), money.parse_decimal(F.col("balance")).alias("bal"),
    )


_RECON = _LINES + """, g AS (SELECT statement_id, sum(coalesce(debit, 0)) AS d, sum(coalesce(credit, 0)) AS c, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT t.statement_id, opening_balance, closing_balance, coalesce(c, 0) - coalesce(d, 0) AS net, coalesce(n, 0) AS n_rows FROM statements t LEFT JOIN g USING (statement_id)) """


@R.add(_RECON + "SELECT statement_id, CAST(coalesce(opening_balance, closing_balance - net) AS DOUBLE) AS inferred_opening, CAST(coalesce(closing_balance, opening_balance + net) AS DOUBLE) AS inferred_closing FROM r")
def boundary_infer(spark: SparkSession, d: str) -> DataFrame:
    x = ledger.reconcile(table(spark, d, "statements"), lines(spark, d), "statement_id", "opening_balance", "closing_balance", "debit", "credit")
    return x.select("statement_id", num("inferred_opening"), num("inferred_closing"))


@R.add(_RECON + "SELECT statement_id, n_rows, coalesce(abs(coalesce(opening_balance, closing_balance - net) + net - coalesce(closing_balance, opening_balance + net)) >= 0.01, FALSE) AS mismatch FROM r")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    x = ledger.reconcile(table(spark, d, "statements"), lines(spark, d), "statement_id", "opening_balance", "closing_balance", "debit", "credit")
    return x.select("statement_id", "n_rows", "mismatch")


@R.add(L + " SELECT account_key, CAST(day AS VARCHAR) AS day, CAST(arg_max(bal, seq) AS DOUBLE) AS eod_balance FROM l WHERE bal IS NOT NULL GROUP BY account_key, day")
def eod_balance(spark: SparkSession, d: str) -> DataFrame:
    return ledger.eod_balance(base(spark, d), "account_key", "day", ["seq"], "bal").select("account_key", F.col("day").cast("string"), num("eod_balance"))


@R.add("""WITH w AS (SELECT statement_id AS id, account_key AS account, period_end, closing_balance, lead(statement_id) OVER o AS next_id, lead(period_start) OVER o AS nstart,
  lead(opening_balance) OVER o AS nopen FROM statements WINDOW o AS (PARTITION BY account_key ORDER BY period_start, period_end, statement_id)),
g AS (SELECT *, CAST(nstart - period_end AS INTEGER) AS gap_days FROM w WHERE next_id IS NOT NULL)
SELECT id, account, next_id, gap_days, 'MISSING_STATEMENT_PERIOD' AS issue FROM g WHERE gap_days > 35
UNION ALL SELECT id, account, next_id, gap_days, 'CROSS_STATEMENT_BALANCE_DISCONTINUITY' FROM g WHERE gap_days > 0 AND abs(closing_balance - nopen) >= 0.01""")
def statement_gap(spark: SparkSession, d: str) -> DataFrame:
    return ledger.statement_gaps(table(spark, d, "statements"), "account_key", "period_start", "period_end", "opening_balance", "closing_balance", "statement_id")


@R.add("SELECT coalesce(currency, 'INR') AS currency, CAST(sum(debit) AS DOUBLE) AS total_debit, CAST(sum(credit) AS DOUBLE) AS total_credit, count(*) AS n FROM transactions GROUP BY 1")
def totals_by_currency(spark: SparkSession, d: str) -> DataFrame:
    return ledger.totals_by_currency(table(spark, d, "transactions"), "currency", "debit", "credit").select("currency", num("total_debit"), num("total_credit"), "n")


@R.add(L + """, n AS (SELECT seq, row_number() OVER (ORDER BY day, account_key, seq) AS k FROM l)
SELECT seq, 'TXN-' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END AS number FROM n""")
def txn_renumber(spark: SparkSession, d: str) -> DataFrame:
    return ledger.renumber(base(spark, d), ["day", "account_key", "seq"], "day").select("seq", "number")


@R.add(L + """, n AS (SELECT seq, account_key, row_number() OVER (PARTITION BY account_key ORDER BY seq) AS i, count(*) OVER (PARTITION BY account_key) AS n FROM l)
SELECT seq, account_key, i AS row_no FROM n WHERE i <= 3 OR i > n - 3 OR i = n // 3 OR i = (n // 3) * 2""")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return ledger.sample_rows(base(spark, d), ["account_key"], "seq").select("seq", "account_key", "row_no")


@R.add(_LINES + """, k AS (SELECT *, CASE WHEN coalesce(debit, credit) IS NULL THEN 'CONTINUATION' ELSE 'TRANSACTION' END AS kind FROM s),
g AS (SELECT *, sum(CASE WHEN kind = 'TRANSACTION' THEN 1 ELSE 0 END) OVER (PARTITION BY statement_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM k)
SELECT statement_id, min(CASE WHEN kind = 'TRANSACTION' THEN row_id END) AS row_id, coalesce(string_agg(description, ' ' ORDER BY row_id), '') AS merged, count(*) AS n_parts FROM g GROUP BY statement_id, grp""")
def continuation_merge(spark: SparkSession, d: str) -> DataFrame:
    x = written(lines(spark, d)).withColumn("kind", F.when(F.coalesce("debit", "credit").isNull(), "CONTINUATION").otherwise("TRANSACTION"))
    return ledger.continuation_merge(x, ["statement_id"], "row_id", "kind", "description").select("statement_id", "row_id", "merged", F.col("n_parts").cast("long"))


_ISO = "CASE WHEN regexp_matches(trim(date), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN TRY_CAST(trim(date) AS DATE) END"


@R.add(f"""WITH a AS (SELECT row_id, statement_id, {_ISO} AS day, date IS NULL OR trim(date) IN ('', '--', '"', 'do', 'ditto') AS blank FROM statement_rows),
b AS (SELECT *, max(CASE WHEN NOT blank THEN row_id END) OVER (PARTITION BY statement_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS src FROM a)
SELECT b.row_id, CAST(coalesce(b.day, CASE WHEN b.blank THEN s.day END) AS VARCHAR) AS inherited FROM b LEFT JOIN a s ON s.row_id = b.src""")
def date_inherit(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "statement_rows")
    day = F.when(F.trim("date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(F.trim("date"), "yyyy-MM-dd"))
    return ledger.inherit_date(t.withColumn("day", day), ["statement_id"], "row_id", "day", "date").select("row_id", F.col("inherited").cast("string"))


@R.add("""WITH m AS (SELECT row_id, statement_id, max(CASE WHEN lower(date) = 'carried fwd' THEN 1 ELSE 0 END) OVER
  (PARTITION BY statement_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM statement_rows) SELECT row_id, statement_id FROM m WHERE coalesce(past, 0) = 0""")
def table_end_marker(spark: SparkSession, d: str) -> DataFrame:
    return ledger.after_end_marker(table(spark, d, "statement_rows"), ["statement_id"], "row_id", F.lower("date") == "carried fwd").select("row_id", "statement_id")


@R.add()
def intraday_reorder(spark: SparkSession, d: str) -> DataFrame:
    return ledger.intraday_reorder(base(spark, d), ["account_key", "day"], "seq", "debit", "credit", "bal").select("seq", "position")


#: Every pair of rows of a block, by the rules; the operator makes no pairs.
_DUP = _LINES + f""", x AS (SELECT s.row_id AS id, s.statement_id AS st, s.row_index AS sq, h.account_key, coalesce(h.currency, 'INR') AS cur, {cells_sql.day('s.date')} AS day, {cells_sql.time('r.time')} AS tm, s.debit, s.credit, s.bal,
  {cells_sql.words('s.description')} AS t, CASE WHEN trim(s.reference_number) <> '' THEN upper(trim(s.reference_number)) END AS r FROM s JOIN statement_rows r USING (row_id) LEFT JOIN statements h ON h.statement_id = s.statement_id),
y AS (SELECT * FROM x WHERE day IS NOT NULL AND coalesce(debit, credit) IS NOT NULL),
q AS (SELECT b.id, a.id AS of_id, coalesce(a.r = b.r, FALSE) AS by_ref, a.t = b.t AS by_text, coalesce(a.bal = b.bal, FALSE) AS by_bal, a.st IS DISTINCT FROM b.st AS apart, (a.r IS NULL) <> (b.r IS NULL) AS one_ref, a.r IS NULL AND b.r IS NULL AS no_ref, a.t AS ta, b.t AS tb
  FROM y a JOIN y b ON a.account_key IS NOT DISTINCT FROM b.account_key AND a.day = b.day AND a.cur = b.cur AND a.debit IS NOT DISTINCT FROM b.debit AND a.credit IS NOT DISTINCT FROM b.credit AND a.id < b.id
  WHERE coalesce(a.tm = b.tm, TRUE) AND coalesce(a.r = b.r, TRUE) AND coalesce(a.bal = b.bal, TRUE) AND (a.st IS DISTINCT FROM b.st OR a.sq IS NOT DISTINCT FROM b.sq OR coalesce(a.r = b.r, FALSE))),
z AS (SELECT *, by_ref OR (by_text AND by_bal AND (apart OR one_ref)) AS proof, CASE WHEN NOT by_ref AND NOT by_text AND no_ref AND ta <> '' AND tb <> '' THEN 1 - {cells_sql.distance('ta', 'tb')} / greatest(length(ta), length(tb))::DOUBLE >= 0.8 ELSE FALSE END AS near FROM q),
v AS (SELECT id, min(of_id) FILTER (proof) AS proven, min(of_id) FILTER (proof OR by_text OR near) AS any_of FROM z GROUP BY id)
"""


def dated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Statement rows with account, currency, day and time, those with a day and an amount."""
    cells = spread(table(spark, d, "statement_rows").select("row_id", "date", "time"), "row_id")
    t = cells.select("row_id", dates.parse_date("date").alias("day"), dates.parse_time("time").alias("clock"))
    heads = table(spark, d, "statements").select("statement_id", "account_key", F.coalesce("currency", F.lit("INR")).alias("currency"))
    # written, as every use would parse the amounts again, in one expression too long to be compiled
    x = written(lines(spark, d)).join(t, "row_id").join(heads, "statement_id", "left")
    return x.where(F.col("day").isNotNull() & F.coalesce("debit", "credit").isNotNull())


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return ledger.duplicate_transactions(dated_lines(spark, d), "row_id", ["account_key", "day", "currency", "debit", "credit"], "reference_number", "bal", "statement_id", "row_index", "description", "clock")


@R.add(_DUP + "SELECT id, coalesce(proven, any_of) AS of_id, CASE WHEN proven IS NOT NULL THEN 'PROVEN' ELSE 'PROBABLE' END AS verdict FROM v WHERE any_of IS NOT NULL")
def dedup_transactions(spark: SparkSession, d: str) -> DataFrame:
    return duplicates(spark, d)


@R.add(_DUP + """SELECT s.account_key, count(*) AS duplicates FROM v JOIN statement_rows r ON r.row_id = v.id JOIN statements s USING (statement_id) WHERE any_of IS NOT NULL GROUP BY 1""")
def cross_statement_dedup(spark: SparkSession, d: str) -> DataFrame:
    dup = duplicates(spark, d)
    where = lines(spark, d).select(F.col("row_id").alias("id"), "statement_id").join(table(spark, d, "statements").select("statement_id", "account_key"), "statement_id")
    return dup.join(where, "id").groupBy("account_key").agg(F.count(F.lit(1)).alias("duplicates"))


@R.add(_DUP + """, sc AS (SELECT statement_id, count(*) AS scanned, count(*) FILTER (coalesce(debit, credit) IS NOT NULL) AS good FROM s GROUP BY 1),
du AS (SELECT r.statement_id, count(*) AS duplicates FROM v JOIN statement_rows r ON r.row_id = v.id WHERE any_of IS NOT NULL GROUP BY 1),
w1 AS (SELECT t.statement_id, coalesce(scanned, 0) AS scanned, coalesce(good, 0) AS good, coalesce(duplicates, 0) AS duplicates FROM statements t LEFT JOIN sc USING (statement_id) LEFT JOIN du USING (statement_id)),
w2 AS (SELECT *, good - least(duplicates, good) AS success FROM w1)
SELECT w2.statement_id, scanned, success, duplicates, greatest(0, scanned - success - duplicates) AS failed, CASE WHEN t.closing_balance IS NULL THEN 'MISSING_CLOSING_BALANCE' ELSE 'ALL_CLEAR' END AS issues
FROM w2 JOIN statements t USING (statement_id)""")
def sink_processing_summary(spark: SparkSession, d: str) -> DataFrame:
    s, x = table(spark, d, "statements"), lines(spark, d).withColumn("ok", F.coalesce("debit", "credit").isNotNull())
    dup = duplicates(spark, d)
    issues = s.where("closing_balance is null").select("statement_id", F.lit("MISSING_CLOSING_BALANCE").alias("issue"))
    return ledger.processing_summary(s, x, dup, issues, "statement_id", "row_id")


@R.add("""SELECT account_key, min(bank_name) AS bank_name, min(masked_account_number) AS masked, count(*) AS statements, CAST(min(period_start) AS VARCHAR) AS first_day, CAST(max(period_end) AS VARCHAR) AS last_day
FROM statements GROUP BY account_key""")
def sink_accounts_directory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statements").groupBy("account_key").agg(
        F.min("bank_name").alias("bank_name"), F.min("masked_account_number").alias("masked"), F.count(F.lit(1)).alias("statements"),
        F.min("period_start").cast("string").alias("first_day"), F.max("period_end").cast("string").alias("last_day"),
    )


@R.add("""WITH f AS (SELECT transaction_id, account_key, description, debit, CAST(coalesce(debit, credit) AS VARCHAR) AS a FROM transactions), p AS (SELECT *, split_part(a, '.', 1) AS w FROM f),
g AS (SELECT *, reverse(regexp_replace(reverse(left(w, greatest(length(w) - 3, 0))), '([0-9][0-9])', '\\1,', 'g')) AS h FROM p)
SELECT transaction_id, account_key, description, CASE WHEN length(w) > 3 THEN ltrim(h, ',') || ',' || right(w, 3) ELSE w END || '.' || split_part(a, '.', 2) AS amount, CASE WHEN debit IS NOT NULL THEN 'Dr' ELSE 'Cr' END AS side FROM g""")
def sink_passbook(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transactions")
    return t.select("transaction_id", "account_key", "description", money.indian_format(F.coalesce("debit", "credit")).alias("amount"), F.when(F.col("debit").isNotNull(), "Dr").otherwise("Cr").alias("side"))


@R.add(r"""SELECT account_key, transaction_id, source_input_id, transaction_mode, coalesce(currency, 'INR') AS currency, description, transaction_date, CAST(CAST(coalesce(debit, 0) AS DECIMAL(18,2)) AS VARCHAR) AS debit, CAST(CAST(coalesce(credit, 0) AS DECIMAL(18,2)) AS VARCHAR) AS credit,
 CAST(CAST(coalesce(credit, 0) - coalesce(debit, 0) AS DECIMAL(18,2)) AS VARCHAR) AS net, CASE WHEN debit IS NOT NULL THEN 'DEBIT' WHEN credit IS NOT NULL THEN 'CREDIT' END AS direction, CAST(CAST(loaded_at AS DATE) AS VARCHAR) AS loaded_on, to_json({'source': source_input_id, 'raw_balance': balance}) AS provenance,
 substr(sha256(lower(trim(account_key)) || ':' || lower(trim(CAST(transaction_id AS VARCHAR)))), 1, 16) AS transaction_hash FROM transactions""")
def sink_ledger_parquet(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the ledger file, with its row digests."""
    t = table(spark, d, "transactions")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,2)")
    return t.select(
        "account_key", "transaction_id", "source_input_id", "transaction_mode", F.coalesce("currency", F.lit("INR")).alias("currency"), "description", "transaction_date",
        zero("debit").cast("string").alias("debit"), zero("credit").cast("string").alias("credit"), (zero("credit") - zero("debit")).cast("decimal(18,2)").cast("string").alias("net"),
        F.when(F.col("debit").isNotNull(), "DEBIT").when(F.col("credit").isNotNull(), "CREDIT").alias("direction"), F.to_date("loaded_at").cast("string").alias("loaded_on"),
        F.to_json(F.struct(F.col("source_input_id").alias("source"), F.col("balance").alias("raw_balance")), {"ignoreNullFields": "false"}).alias("provenance"),
        identifiers.fingerprint(F.col("account_key"), F.col("transaction_id").cast("string")).alias("transaction_hash"),
    )


@R.add("""SELECT t.transaction_id, s.statement_id FROM transactions t LEFT JOIN (SELECT account_key, min(statement_id) AS statement_id FROM statements GROUP BY 1) s USING (account_key)""")
def join_stmt_txn(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "statements").groupBy("account_key").agg(F.min("statement_id").alias("statement_id"))
    return table(spark, d, "transactions").select("transaction_id", "account_key").join(first, "account_key", "left").select("transaction_id", "statement_id")


@R.add(_LINES + """ SELECT row_id, CASE WHEN debit IS NULL AND credit IS NULL THEN 'MISSING_AMOUNT' WHEN debit > 0 AND credit > 0 THEN 'DUAL_DIRECTION_AMOUNT' END AS issue,
CASE WHEN debit IS NULL AND credit IS NULL THEN 'INVALID' WHEN debit > 0 AND credit > 0 THEN 'WARNING' ELSE 'VALID' END AS status FROM s""")
def txn_validate(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)
    missing, dual = F.col("debit").isNull() & F.col("credit").isNull(), (F.col("debit") > 0) & (F.col("credit") > 0)
    return x.select("row_id", F.when(missing, "MISSING_AMOUNT").when(dual, "DUAL_DIRECTION_AMOUNT").alias("issue"), F.when(missing, "INVALID").when(dual, "WARNING").otherwise("VALID").alias("status"))


@R.add("""SELECT a.source_input_id, coalesce(x, 0) AS first_half, coalesce(y, 0) AS second_half, coalesce(y, 0) - coalesce(x, 0) AS delta FROM (SELECT DISTINCT source_input_id FROM transactions WHERE source_input_id IS NOT NULL) a
LEFT JOIN (SELECT source_input_id, count(*) AS x FROM transactions WHERE loaded_at < TIMESTAMP '2023-07-01' GROUP BY 1) p USING (source_input_id) LEFT JOIN (SELECT source_input_id, count(*) AS y FROM transactions WHERE loaded_at >= TIMESTAMP '2023-07-01' GROUP BY 1) q USING (source_input_id)""")
def join_run_compare(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transactions").where("source_input_id is not null")
    early = F.col("loaded_at") < F.lit("2023-07-01").cast("timestamp_ntz")
    x = t.groupBy("source_input_id").agg(F.count_if(early).alias("first_half"), F.count_if(~early).alias("second_half"))
    return x.withColumn("delta", F.col("second_half") - F.col("first_half"))


@R.add(f"SELECT row_id, CAST({_AMOUNT.format(c='debit')} AS DOUBLE) AS debit, CAST({_AMOUNT.format(c='credit')} AS DOUBLE) AS credit FROM statement_rows")
def parse_decimal(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("row_id", num("debit"), num("credit"))


@R.add(f"""WITH a AS (SELECT row_id, balance, CAST({_AMOUNT.format(c='balance')} AS DOUBLE) AS v FROM statement_rows)
SELECT row_id, CASE WHEN regexp_matches(lower(trim(balance)), '(^|[^a-z])(dr|od)\\.?$') THEN -abs(v) WHEN regexp_matches(lower(trim(balance)), '(^|[^a-z])cr\\.?$') THEN abs(v) ELSE v END AS balance FROM a""")
def parse_balance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statement_rows").select("row_id", money.parse_balance(F.col("balance")).cast("double").alias("balance"))


@R.add("""SELECT transaction_id, CASE WHEN regexp_matches(lower(description), 'upi') THEN 'UPI' WHEN regexp_matches(lower(description), 'neft') THEN 'NEFT' WHEN regexp_matches(lower(description), 'rtgs') THEN 'RTGS'
WHEN regexp_matches(lower(description), 'imps') THEN 'IMPS' WHEN regexp_matches(lower(description), 'cash|atm') THEN 'CASH' WHEN regexp_matches(lower(description), 'chq|cheque|clg') THEN 'CHEQUE'
WHEN regexp_matches(lower(description), 'chg|charge|fee') THEN 'CHARGES' WHEN regexp_matches(lower(description), 'interest|int cr') THEN 'INTEREST' WHEN regexp_matches(lower(description), 'transfer|trf') THEN 'TRANSFER' END AS mode FROM transactions""")
def transaction_mode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transactions").select("transaction_id", money.transaction_mode(F.col("description")).alias("mode"))


@R.add("""SELECT row_id, CASE WHEN lower(trim(time)) IN ('', '-', '--', 'na', 'n/a', 'nil', 'null') THEN NULL ELSE trim(time) END AS time FROM statement_rows""")
def placeholder_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statement_rows").select("row_id", money.placeholder_clean(F.col("time")).alias("time"))


@R.add("""SELECT record_id, CASE WHEN lower(trim(b)) IN ('dr', 'd', 'debit', 'w', 'withdrawal', '-1') THEN abs(a) END AS debit, CASE WHEN lower(trim(b)) IN ('cr', 'c', 'credit', 'deposit', '1') THEN abs(a) END AS credit
FROM (SELECT result_id AS record_id, CAST(protected_spans_count AS DOUBLE) - 2 AS a, CASE WHEN direction = 'hi-en' THEN 'Dr' WHEN direction = 'en-hi' THEN 'CR' ELSE 'x' END AS b FROM translations)""")
def debit_credit_resolve(spark: SparkSession, d: str) -> DataFrame:
    way = F.when(F.col("direction") == "hi-en", "Dr").when(F.col("direction") == "en-hi", "CR").otherwise("x")
    none = F.lit(None).cast("double")
    got = money.debit_credit(none, none, F.col("protected_spans_count").cast("double") - 2, way)
    return table(spark, d, "translations").select(F.col("result_id").alias("record_id"), got.alias("x")).select("record_id", "x.debit", "x.credit")
