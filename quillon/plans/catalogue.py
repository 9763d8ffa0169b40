"""The registered queries of the ledger, each with its SQL.

The tables of the star schema stand for a ledger: customers are accounts, orders import
batches, line items raw records and movements, part types categories, events an
observation log, document texts artifacts.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import dates, ids, money, text
from quillon.operators import constraints, lifecycle, reconcile, report
from quillon.sources import statements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = F.col("c_custkey") % 4 == 0
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_name").alias("display_name"),
        F.when(card, "CREDIT_CARD").otherwise("CURRENT").alias("kind"),
        F.when(card, "LIABILITY").otherwise("ASSET").alias("economic_orientation"),
        F.lit("CLP").alias("currency"),
    )


def amount(c: str) -> Column:
    return F.col(c).cast(money.MONEY)


def movements(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Line items of orders, with ``more`` of the orders; a return is positive, other flags are negative."""
    signed = F.when(F.col("l_returnflag") == "R", amount("l_extendedprice")).otherwise(-amount("l_extendedprice"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *more)
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("movement_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("l_shipdate").cast("date").alias("occurrence_date"),
        signed.cast(money.MONEY).alias("signed_amount"),
        F.col("l_orderkey").alias("import_batch_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_linenumber").alias("line"),
        "l_quantity",
        "l_suppkey",
        *orders.columns[2:],
    )


_MOVEMENTS = """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS movement_id, o_custkey AS account_id,
  CAST(l_shipdate AS DATE) AS occurrence_date, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(20,2)) AS signed_amount,
  l_orderkey AS import_batch_id, l_partkey AS part_id, l_linenumber AS line, l_quantity, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
_OUTCOME = "CASE l_returnflag WHEN 'A' THEN 'PARSED' WHEN 'N' THEN 'IGNORED' ELSE 'REJECTED' END"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("l_returnflag") == "A", "PARSED").when(F.col("l_returnflag") == "N", "IGNORED").otherwise("REJECTED")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("import_batch_id"), outcome.alias("outcome"), amount("l_extendedprice").alias("signed_amount"))


@query(f"""WITH m AS ({_MOVEMENTS}) SELECT movement_id, account_id, occurrence_date, signed_amount, import_batch_id, o_orderstatus AS import_status
  FROM m JOIN orders ON import_batch_id = o_orderkey WHERE account_id = 7 AND occurrence_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'""")
def report_movements(spark, sf_dir):
    rows = movements(spark, sf_dir, F.col("o_orderstatus").alias("import_status"))
    found = report.movements_between(rows, 7, datetime.date(1995, 1, 1), datetime.date(1997, 12, 31))
    return found.select("movement_id", "account_id", "occurrence_date", "signed_amount", "import_batch_id", "import_status")


@query(f"""WITH m AS ({_MOVEMENTS}) SELECT c_custkey AS account_id, count(movement_id) AS movement_count, CAST(coalesce(sum(signed_amount), 0) AS DECIMAL(38,2)) AS net_signed_amount
  FROM customer LEFT JOIN m ON account_id = c_custkey GROUP BY 1""")
def report_totals(spark, sf_dir):
    return report.account_totals(accounts(spark, sf_dir), movements(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three line numbers one is never assigned, one cleared, one in its part's type."""
    rows = movements(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("type"))
    given = rows.filter("line % 3 <> 0").join(parts, "part_id").groupBy("movement_id").agg(F.max(F.when(F.col("line") % 3 == 2, F.col("type"))).alias("category_id"), F.max(F.col("line").cast("long")).alias("revision"))
    categories = table(spark, sf_dir, "part").select(F.col("p_type").alias("category_id")).distinct().select("category_id", F.initcap("category_id").alias("display_name"), (F.col("category_id") != "ECONOMY").alias("is_active"))
    return report.classified(rows, given, categories)


_CLASSIFIED = f"""m AS ({_MOVEMENTS}), g AS (SELECT movement_id, max(CASE WHEN line % 3 = 2 THEN p_type END) AS category_id, max(line) AS revision FROM m JOIN part ON part_id = p_partkey WHERE line % 3 <> 0 GROUP BY 1),
  r AS (SELECT m.*, g.category_id, CASE WHEN g.movement_id IS NULL THEN 'NEVER_ASSIGNED' WHEN g.category_id IS NULL THEN 'CLEARED' ELSE 'CLASSIFIED' END AS state, coalesce(revision, 0) AS revision FROM m LEFT JOIN g USING (movement_id))"""


@query(f"WITH {_CLASSIFIED} SELECT movement_id, state, category_id, category_id <> 'ECONOMY' AS category_active, CAST(revision AS BIGINT) AS revision, signed_amount FROM r")
def classified_report(spark, sf_dir):
    return classified(spark, sf_dir).select("movement_id", "state", "category_id", "category_active", "revision", "signed_amount")


@query(f"WITH {_CLASSIFIED} SELECT state, coalesce(category_id, '(none)') AS category, count(*) AS movement_count, CAST(sum(signed_amount) AS DECIMAL(38,2)) AS net_signed_amount FROM r GROUP BY 1, 2")
def category_totals(spark, sf_dir):
    rows = classified(spark, sf_dir).withColumn("category", F.coalesce("category_id", F.lit("(none)")))
    return report.totals(rows, "state", "category")


_COUNTS = f"""SELECT l_orderkey AS import_batch_id, count(*) FILTER ({_OUTCOME} = 'PARSED') AS parsed, count(*) FILTER ({_OUTCOME} = 'IGNORED') AS ignored, count(*) FILTER ({_OUTCOME} = 'REJECTED') AS rejected FROM lineitem GROUP BY 1"""


@query(f"WITH c AS ({_COUNTS}) SELECT *, parsed + ignored + rejected AS source_rows, CASE WHEN rejected = 0 THEN 'ACCEPTED' WHEN parsed > 0 THEN 'PARTIAL' ELSE 'REJECTED' END AS status FROM c")
def batch_status(spark, sf_dir):
    return reconcile.batch_status(records(spark, sf_dir))


@query(f"""WITH c AS (SELECT l_orderkey AS import_batch_id, count(*) FILTER ({_OUTCOME} = 'PARSED') AS p, count(*) FILTER ({_OUTCOME} = 'REJECTED') AS r,
    coalesce(sum(CAST(l_extendedprice AS DECIMAL(20,2))) FILTER ({_OUTCOME} = 'PARSED'), 0) AS s FROM lineitem GROUP BY 1),
  d AS (SELECT o_orderkey AS import_batch_id, coalesce(p, 0) AS p, coalesce(r, 0) AS r, CAST(CAST(o_totalprice AS DECIMAL(20,2)) - coalesce(s, 0) AS DECIMAL(38,2)) AS d FROM orders LEFT JOIN c ON import_batch_id = o_orderkey),
  k AS (SELECT *, CASE WHEN p = 0 AND r = 0 THEN 'NOT_APPLICABLE' WHEN r > 0 THEN 'INSUFFICIENT_DATA' WHEN d = 0 THEN 'RECONCILED' ELSE 'NOT_RECONCILED' END AS k FROM d)
  SELECT import_batch_id, k AS reconciliation_status, CASE WHEN k IN ('RECONCILED', 'NOT_RECONCILED') THEN d END AS difference FROM k""")
def reconcile_batches(spark, sf_dir):
    batches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("import_batch_id"), F.lit(0).cast(money.MONEY).alias("opening_balance"), amount("o_totalprice").alias("ending_balance"))
    return reconcile.balance_equation(records(spark, sf_dir), batches)


_ORDER = ["occurrence_date", "movement_id", "signed_amount", "l_quantity"]


@query(f"""WITH m AS ({_MOVEMENTS}) SELECT account_id, movement_id, occurrence_date, signed_amount, l_quantity,
  CAST(sum(signed_amount) OVER (PARTITION BY account_id ORDER BY {', '.join(_ORDER)} ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS running_balance FROM m""")
def running_balance(spark, sf_dir):
    rows = movements(spark, sf_dir).select("account_id", *_ORDER)
    return reconcile.running_balance(rows, "account_id", _ORDER, F.trunc("occurrence_date", "quarter"))


@query(f"""WITH m AS ({_MOVEMENTS}), b AS (SELECT *, CAST(sum(signed_amount) OVER w AS DECIMAL(38,2)) + CASE WHEN line = 5 THEN 1 ELSE 0 END AS balance, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY account_id ORDER BY {', '.join(_ORDER)} ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT account_id, n, coalesce(lag(balance) OVER (PARTITION BY account_id ORDER BY n), 0) + signed_amount - balance AS d FROM b)
  SELECT account_id, min(n) AS "row", CAST(arg_min(d, n) AS DECIMAL(38,2)) AS difference FROM d WHERE d <> 0 GROUP BY 1""")
def continuity_breaks(spark, sf_dir):
    """Every fifth line's printed balance is one too much."""
    rows = reconcile.running_balance(movements(spark, sf_dir), "account_id", _ORDER, F.trunc("occurrence_date", "quarter"))
    rows = rows.withColumn("balance", F.col("running_balance") + F.when(F.col("line") == 5, 1).otherwise(0))
    return reconcile.continuity(rows, F.lit(0).cast(money.MONEY), "account_id", _ORDER, F.trunc("occurrence_date", "quarter"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS artifact_id, count(*) AS copies, false AS collision FROM documents GROUP BY 1")
def artifact_dedup(spark, sf_dir):
    return lifecycle.register(table(spark, sf_dir, "documents"), "text", "doc_id")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 5 == 0, "FATAL").otherwise("ACCEPTED")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("attempt_id"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.col("lang").alias("account_id"), F.when(F.col("doc_id") % 7 == 0, "PDF").otherwise("XLSX").alias("source_kind"), F.col("doc_id").alias("completed_at"), status.alias("status"))


@query("""WITH a AS (SELECT doc_id AS attempt_id, sha256(text) AS digest, lang AS account_id, CASE WHEN doc_id % 7 = 0 THEN 'PDF' ELSE 'XLSX' END AS source_kind, CASE WHEN doc_id % 5 = 0 THEN 'FATAL' ELSE 'ACCEPTED' END AS status FROM documents),
  f AS (SELECT *, min(CASE WHEN status <> 'FATAL' THEN attempt_id END) OVER (PARTITION BY digest, account_id ORDER BY attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first FROM a)
  SELECT f.attempt_id, CASE WHEN first IS NULL THEN f.status WHEN b.source_kind = f.source_kind THEN 'DUPLICATE' ELSE 'FATAL' END AS decision,
    CASE WHEN b.source_kind = f.source_kind THEN first END AS duplicate_of, CASE WHEN b.source_kind <> f.source_kind THEN 'source_kind_conflict' END AS failure_code FROM f LEFT JOIN a AS b ON first = b.attempt_id""")
def import_attempts(spark, sf_dir):
    return lifecycle.attempts(_attempts(spark, sf_dir)).select("attempt_id", "decision", "duplicate_of", "failure_code")


@query(f"""WITH m AS ({_MOVEMENTS}) SELECT * FROM (SELECT movement_id, l_suppkey, occurrence_date, l_quantity, count(*) OVER (PARTITION BY l_suppkey, occurrence_date, l_quantity) AS candidates FROM m) WHERE candidates > 1""")
def exact_collisions(spark, sf_dir):
    rows = movements(spark, sf_dir).select("movement_id", "l_suppkey", "occurrence_date", "l_quantity")
    return lifecycle.collisions(rows, "l_suppkey", "occurrence_date", "l_quantity")


@query("SELECT c_custkey AS account_id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer")
def pending_accounts(spark, sf_dir):
    rows, key = accounts(spark, sf_dir).select("account_id"), F.col("account_id") == F.col("o_custkey")
    pending = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return rows.join(pending, key, "left_semi").withColumn("pending", F.lit(True)).union(rows.join(pending, key, "left_anti").withColumn("pending", F.lit(False)))


_ACTION = {"click": "CONFIRM_NEW", "error": "REJECT", "purchase": "REOPEN", "signup": "MARK_CONFLICT", "view": "MATCH_EXISTING"}
_TO = {"click": "RESOLVED", "error": "REJECTED", "purchase": "UNRESOLVED", "signup": "CONFLICT", "view": "RESOLVED"}
_case = lambda pairs: "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda pairs: F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[F.col("event_type")]
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("observation_id"), "ts", pick(_ACTION).alias("action"), pick(_TO).alias("to_state"))


_LOG = f"SELECT event_id, user_id AS observation_id, ts, {_case(_ACTION)} AS action, {_case(_TO)} AS to_state FROM events"
_SEQUENCE = f"SELECT *, row_number() OVER w AS sequence, coalesce(lag(to_state) OVER w, 'UNRESOLVED') AS from_state FROM ({_LOG}) WINDOW w AS (PARTITION BY observation_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, observation_id, action, from_state, to_state, sequence FROM ({_SEQUENCE})")
def resolution_sequence(spark, sf_dir):
    return lifecycle.sequence(_log(spark, sf_dir), "observation_id", ["ts", "event_id"]).drop("ts")


@query(f"SELECT event_id, observation_id, action, from_state, to_state, sequence FROM ({_SEQUENCE}) WHERE (action, from_state, to_state) NOT IN ({', '.join(map(str, lifecycle.TRANSITIONS))})")
def illegal_transitions(spark, sf_dir):
    return lifecycle.illegal(resolution_sequence(spark, sf_dir))


@query(f"SELECT observation_id, arg_max(to_state, (ts, event_id)) AS state, count(*) AS state_version FROM ({_LOG}) GROUP BY 1")
def observation_state(spark, sf_dir):
    return lifecycle.state(_log(spark, sf_dir), "observation_id", F.struct("ts", "event_id"))


_AFTER = "CASE " + " ".join(f"WHEN action = '{a}' AND state = '{f}' THEN '{t}'" for a, f, t in lifecycle.TRANSITIONS) + " END"


@query(f"""WITH RECURSIVE c AS (SELECT event_id, observation_id, action, row_number() OVER (PARTITION BY observation_id ORDER BY ts, event_id) AS n FROM ({_LOG})),
  r AS (SELECT DISTINCT observation_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS action, NULL::VARCHAR AS from_state, 'UNRESOLVED' AS state, 0 AS done, NULL::VARCHAR AS next FROM c
    UNION ALL SELECT observation_id, n, event_id, action, state, coalesce(next, state), done + CAST(next IS NOT NULL AS INTEGER), next FROM (SELECT c.*, r.state, r.done, {_AFTER.replace('action', 'c.action').replace(' state', ' r.state')} AS next FROM r JOIN c ON c.observation_id = r.observation_id AND c.n = r.n + 1))
  SELECT event_id, observation_id, action, from_state, state AS to_state, CASE WHEN next IS NOT NULL THEN done END AS sequence, CASE WHEN next IS NULL THEN 'transition_invalid' END AS code FROM r WHERE n > 0""")
def resolution_replay(spark, sf_dir):
    """A command is refused where the state, as all before left it, forbids it."""
    return lifecycle.replay(_log(spark, sf_dir).select("event_id", "observation_id", "ts", "action"), "observation_id", ["ts", "event_id"]).drop("ts")


@query()
def classification_replay(spark, sf_dir):
    """A fold: commands expect the revision that their number in the user's day makes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    categories = table(spark, sf_dir, "part").select(F.col("p_type").alias("category_id")).distinct().withColumn("is_active", F.col("category_id") != "ECONOMY")
    wanted = F.when(F.col("event_type") == "click", "ECONOMY").when(F.col("event_type") == "view", "PROMO").when(F.col("event_type") == "signup", "STANDARD").when(F.col("event_type") == "error", "NONE SUCH")
    commands = table(spark, sf_dir, "events").select(F.col("event_id").alias("command_id"), F.col("user_id").alias("movement_id"), wanted.alias("category_id"), F.floor(F.row_number().over(w) / 3).cast("long").alias("expected_revision"), "ts")
    return lifecycle.classify(commands, categories, order=("ts", "command_id")).drop("ts")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS date, o_orderstatus <> 'F' AS valid FROM orders)
  SELECT o_orderkey, coalesce(date < max(CASE WHEN valid THEN date END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS out_of_order FROM o""")
def date_order_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("date"))
    return reconcile.date_order(rows, "o_custkey", ["o_orderkey"], F.col("o_orderstatus") != "F", block=F.floor(F.col("o_orderkey") / 4096)).select("o_orderkey", "out_of_order")


@query(f"""WITH c AS ({_COUNTS}), b AS (SELECT import_batch_id AS k, parsed AS p, ignored AS i, rejected AS r,
    CASE WHEN k % 11 = 0 THEN 'ACCEPTED' WHEN k % 13 = 0 THEN 'FATAL' WHEN k % 17 = 0 THEN 'REJECTED' WHEN k % 19 = 0 THEN 'PARTIAL' WHEN k % 23 = 0 THEN 'OPEN' WHEN rejected = 0 THEN 'ACCEPTED' WHEN parsed > 0 THEN 'PARTIAL' ELSE 'REJECTED' END AS s FROM c JOIN orders ON import_batch_id = o_orderkey)
  SELECT 'kind_orientation' AS constraint_name, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 12 = 0
  UNION ALL SELECT 'status_known', CAST(k AS VARCHAR) FROM b WHERE s = 'OPEN'
  UNION ALL SELECT 'counts_match_status', CAST(k AS VARCHAR) FROM b WHERE CASE s WHEN 'ACCEPTED' THEN r > 0 WHEN 'PARTIAL' THEN p = 0 OR r = 0 WHEN 'REJECTED' THEN p > 0 OR r = 0 WHEN 'FATAL' THEN p + i + r > 0 END
  UNION ALL SELECT 'period_order', CAST(k AS VARCHAR) FROM b WHERE k % 7 = 0
  UNION ALL SELECT 'unique_record', concat_ws('|', l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
  UNION ALL SELECT 'batch_has_account', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)""")
def constraint_violations(spark, sf_dir):
    """Accounts, batches with statuses and periods of their own, some wrong on purpose, and orders."""
    held = accounts(spark, sf_dir)
    wrong = held.withColumn("economic_orientation", F.when(F.col("account_id") % 12 == 0, "ASSET").otherwise(F.col("economic_orientation")))
    orders, k = table(spark, sf_dir, "orders"), F.col("import_batch_id")
    day = F.col("o_orderdate").cast("date")
    periods = orders.select(F.col("o_orderkey").alias("import_batch_id"), day.alias("period_start"), F.date_add(day, F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(30)).alias("period_end"))
    told = F.when(k % 11 == 0, "ACCEPTED").when(k % 13 == 0, "FATAL").when(k % 17 == 0, "REJECTED").when(k % 19 == 0, "PARTIAL").when(k % 23 == 0, "OPEN")
    counts = reconcile.batch_status(records(spark, sf_dir)).join(periods, "import_batch_id").withColumn("status", F.coalesce(told, "status"))
    return constraints.every(
        constraints.broken(wrong, "account_id", **constraints.account_rules()),
        constraints.broken(counts, "import_batch_id", **constraints.batch_rules()),
        constraints.repeated(table(spark, sf_dir, "lineitem"), "unique_record", "l_orderkey", "l_linenumber"),
        constraints.dangling(orders, "batch_has_account", "o_orderkey", "o_custkey", held.filter("kind = 'CURRENT'"), "account_id"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(20,2)) END AS value,
  CASE WHEN l_linenumber % 4 = 3 THEN 'negative_source_amount' END AS code FROM lineitem""")
def money_parse(spark, sf_dir):
    """Prices printed in four forms, one of them negative, and read again."""
    price, n = amount("l_extendedprice"), F.col("l_linenumber") % 4
    points = F.translate(F.format_number(price, 2), ",.", ".,")
    printed = F.when(n == 0, F.concat(F.lit("$ "), points)).when(n == 1, F.format_number(price, 2)).when(n == 2, F.translate(price.cast("string"), ".", ",")).otherwise(F.concat(F.lit("-"), points))
    read = money.sheet_amount(printed)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", read["value"].alias("value"), read["code"].alias("code"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - 200 AS s, CAST(o_orderdate AS DATE) + CAST(CASE o_orderkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 300 ELSE -100 END AS INTEGER) AS e FROM orders),
  c AS (SELECT o_orderkey, (SELECT list(x) FROM (SELECT TRY_CAST(concat(y, strftime(d, '-%m-%d')) AS DATE) AS x FROM range(year(s) - 1, year(e) + 2) t(y)) WHERE x BETWEEN s AND e) AS found FROM d)
  SELECT o_orderkey, CASE WHEN len(found) = 1 THEN found[1] END AS value, CASE WHEN coalesce(len(found), 0) <> 1 THEN 'date_year_ambiguous' END AS code FROM c""")
def year_resolution(spark, sf_dir):
    """Days and months of orders, in periods that hold them once, twice or not."""
    d = F.col("o_orderdate").cast("date")
    end = F.when(F.col("o_orderkey") % 3 == 0, F.date_add(d, 100)).when(F.col("o_orderkey") % 3 == 1, F.date_add(d, 300)).otherwise(F.date_sub(d, 100))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(d, "dd/MM").alias("dm"), F.date_sub(d, 200).alias("s"), end.alias("e"))
    found = dates.resolved(F.col("dm"), F.col("s"), F.col("e"))
    return rows.select("o_orderkey", found["value"].alias("value"), found["code"].alias("code"))


@query(f"""WITH h AS (SELECT c_custkey, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(c_name)) AS h FROM customer)
  SELECT c_custkey, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3), substr(h, 21, 12)) AS id FROM h""")
def uuid5_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", ids.uuid5(NAMESPACE, F.col("c_name")).alias("id"))


@query("SELECT c_custkey AS account_id, c_name AS display_name, CASE WHEN c_custkey % 4 = 0 THEN 'CREDIT_CARD' ELSE 'CURRENT' END AS kind, 'CLP' AS currency FROM customer")
def account_discovery(spark, sf_dir):
    return report.discover(accounts(spark, sf_dir)).select("account_id", "display_name", "kind", "currency")


_TUPLE = "import_batch_id % 400 AS account_id, CAST(date_trunc('year', occurrence_date) AS DATE) AS date, CAST(l_quantity AS INTEGER) % 5 AS amount"


@query(f"""WITH m AS ({_MOVEMENTS}), o AS (SELECT movement_id AS observation_id, {_TUPLE}, import_batch_id AS b, line AS o, import_batch_id % 5 <> 0 AS can, l_partkey_ % 3 <> 0 AS good FROM (SELECT *, part_id AS l_partkey_ FROM m) WHERE signed_amount < 0),
  h AS (SELECT DISTINCT {_TUPLE} FROM m WHERE signed_amount > 0),
  w AS (SELECT o.*, h.account_id IS NOT NULL AS held, min(CASE WHEN can THEN b END) OVER (PARTITION BY o.account_id, o.date, o.amount) AS owner FROM o LEFT JOIN h ON o.account_id = h.account_id AND o.date = h.date AND o.amount = h.amount),
  x AS (SELECT *, can AND NOT held AND b = owner AS mine FROM w),
  y AS (SELECT *, row_number() OVER (PARTITION BY account_id, date, amount, mine ORDER BY o, observation_id) AS n, first_value(good) OVER (PARTITION BY account_id, date, amount, mine ORDER BY o, observation_id) AS fine,
    row_number() OVER (PARTITION BY account_id, date, amount, mine, good, o ORDER BY observation_id) AS same FROM x),
  r AS (SELECT *, CASE WHEN mine AND n = 1 THEN 'reconciled_historical_new' WHEN mine AND fine AND good AND same = 1 THEN 'same_statement_distinct_ordered_row' END AS reason FROM y)
  SELECT observation_id, CASE WHEN reason IS NULL THEN 'ABSTAIN' ELSE 'CONFIRM_NEW' END AS action, reason FROM r""")
def policy_confirm(spark, sf_dir):
    """Claims of batches of which every fifth isn't accepted; a third of the rows have no balance."""
    rows = movements(spark, sf_dir).select("movement_id", "import_batch_id", "line", "signed_amount", (F.col("import_batch_id") % 400).alias("account_id"), F.trunc("occurrence_date", "year").alias("date"), (F.col("l_quantity").cast("int") % 5).alias("amount"), F.lit("CLP").alias("currency"), (F.col("part_id") % 3 != 0).alias("balanced"), (F.col("import_batch_id") % 5 != 0).alias("eligible"))
    claims = rows.filter("signed_amount < 0").withColumnsRenamed({"movement_id": "observation_id", "import_batch_id": "batch_order", "line": "ordinal"})
    return lifecycle.confirm(claims, rows.filter("signed_amount > 0")).select("observation_id", "action", "reason")


_MARKED = "translate(p_name, 'aeioun', 'ÁéÎõüñ') || ' N' || chr(186) || ' ' || chr(64257) || '  Straße' || chr(160)"
_DECOMPOSED = "strip_accents(replace(replace(replace(_N, chr(64257), 'fi'), chr(186), 'o'), chr(160), ' '))".replace("_N", _MARKED)


def _marked() -> Column:
    """Part names with marks, a ligature, an ordinal sign, a sharp s and a hard blank."""
    return F.concat(F.translate("p_name", "aeioun", "ÁéÎõüñ"), F.lit(" N\u00ba \ufb01  Straße\u00a0"))


@query(f"SELECT p_partkey, regexp_replace(lower(replace({_DECOMPOSED}, ' fi ', '  ')), '[^a-z0-9]', '', 'g') AS label_key FROM part")
def label_keys(spark, sf_dir):
    """Without a Python worker, so the ligature of two letters gives way."""
    return table(spark, sf_dir, "part").select("p_partkey", text.ascii_label_key(_marked()).alias("label_key"))


@query(f"""SELECT p_partkey, regexp_replace(lower({_DECOMPOSED}), '[^a-z0-9]', '', 'g') AS label_key,
  array_to_string(list_filter(string_split_regex(replace(lower({_DECOMPOSED}), 'ß', 'ss'), '\\s+'), lambda x: x <> ''), ' ') AS collapsed FROM part""")
def unicode_keys(spark, sf_dir):
    name = _marked()
    return table(spark, sf_dir, "part").select("p_partkey", text.label_key(name).alias("label_key"), text.collapsed_label(name).alias("collapsed"))


_AMOUNT_CODES = "CASE WHEN {k} % 5 = 0 THEN 'amount_invalid' WHEN {k} % 13 = 0 THEN 'amount_invalid' WHEN {k} % 17 = 0 THEN 'amount_precision_overflow' END"


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice) AS BIGINT) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 9 AS n FROM orders),
  a AS (SELECT *, CASE WHEN o_orderkey % 23 = 0 THEN 'formula_unsupported' WHEN o_orderkey % 19 = 0 THEN 'cell_type_unsupported' END AS alone,
    [CASE WHEN o_orderkey % 7 = 0 THEN 'date_invalid' END, {_AMOUNT_CODES.format(k="o_orderkey")}, CASE WHEN o_orderkey % 29 = 0 THEN 'balance_invalid' WHEN o_orderkey % 31 = 0 THEN 'balance_precision_overflow' END] AS own FROM o),
  b AS (SELECT *, list_filter(own, lambda x: x IS NOT NULL) AS found FROM a),
  r AS (SELECT *, min(CASE WHEN alone IS NULL AND len(found) = 0 THEN d END) OVER (PARTITION BY o_custkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
  c AS (SELECT *, CASE WHEN alone IS NOT NULL THEN [alone] WHEN o_orderkey % 7 <> 0 AND d > before THEN list_append(found, 'source_date_order_invalid') ELSE found END AS codes FROM r)
  SELECT o_orderkey, CASE WHEN len(codes) = 0 THEN 'PARSED' ELSE 'REJECTED' END AS outcome, array_to_string(codes, ',') AS codes, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 THEN CAST(-v AS DECIMAL(20,2)) END AS amount FROM c""")
def cartola_rows(spark, sf_dir):
    """Orders printed as the rows of running statements, with bad dates, missing, malformed and
    overlong amounts and balances, formulas and numbers in some."""
    w, k = Window.partitionBy("o_custkey").orderBy("o_orderkey"), F.col("o_orderkey")
    d, v = F.col("o_orderdate").cast("date"), F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", ".")
    long = F.lit("123.456.789.012.345.678.901")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source_id"), F.lit(0).alias("sheet_ordinal"), (F.row_number().over(w) + 9).alias("row_number"), "o_orderkey",
        F.when(k % 7 == 0, F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "dd-MM-yyyy")).alias("A"), F.col("o_orderpriority").alias("B"), F.lit("").alias("C"),
        F.when(k % 5 == 0, F.concat(v, F.lit(",5 and then some more"))).when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, long).otherwise(F.concat(F.lit("-"), v)).alias("D"),
        F.when(k % 29 == 0, F.lit(None)).when(k % 31 == 0, long).otherwise(v).alias("E"), (k % 23 == 0).alias("has_formula"), (k % 19 == 0).alias("has_other_type"),
    )
    return statements.cartola(rows).select("o_orderkey", "outcome", F.array_join("codes", ",").alias("codes"), "amount")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice) AS BIGINT) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 8 AS n FROM orders),
  a AS (SELECT *, CASE WHEN o_orderkey % 23 = 0 THEN 'formula_unsupported' WHEN o_orderkey % 19 = 0 THEN 'cell_type_unsupported' END AS alone,
    list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'accounting_date_invalid' END, CASE WHEN o_orderkey % 3 = 0 THEN 'direction_xor_invalid' WHEN o_orderkey % 13 = 0 THEN 'amount_invalid' END], lambda x: x IS NOT NULL) AS found FROM o),
  r AS (SELECT *, min(CASE WHEN alone IS NULL AND len(found) = 0 THEN d END) OVER (PARTITION BY o_custkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a),
  c AS (SELECT *, CASE WHEN alone IS NOT NULL THEN [alone] WHEN d > before THEN list_append(found, 'transaction_date_order_invalid') ELSE found END AS codes FROM r)
  SELECT o_orderkey, CASE WHEN len(codes) = 0 THEN 'PARSED' ELSE 'REJECTED' END AS outcome, array_to_string(codes, ',') AS codes, CASE WHEN o_orderkey % 13 <> 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND o_orderkey % 6 <> 3 THEN CAST(v AS DECIMAL(20,2)) END AS charge FROM c""")
def recent_rows(spark, sf_dir):
    """Orders printed as recent movements, a sheet for each customer; of every third neither or
    both a charge and a credit."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    d, v, k = F.col("o_orderdate").cast("date"), F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", "."), F.col("o_orderkey")
    day, shown = F.date_format(d, "dd/MM/yyyy"), F.when(k % 13 == 0, F.concat(v, F.lit("-"))).otherwise(v)
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source_id"), F.lit(0).alias("sheet_ordinal"), (F.row_number().over(w) + 8).alias("row_number"), k, day.alias("A"), F.when(k % 11 == 0, "31/02/2026").otherwise(day).alias("B"), F.col("o_orderpriority").alias("C"),
        F.when((k % 6 != 3) & ((k % 2 == 0) | (k % 3 == 0)), shown).alias("G"), F.when((k % 6 != 3) & ((k % 2 != 0) | (k % 3 == 0)), shown).alias("H"), (k % 23 == 0).alias("has_formula"), (k % 19 == 0).alias("has_other_type"),
    )
    return statements.recent(rows).select("o_orderkey", "outcome", F.array_join("codes", ",").alias("codes"), "charge")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, o_totalprice AS t, o_orderkey % 13 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
  b AS (SELECT *, CASE WHEN n > 8 THEN CASE WHEN n = 9 THEN 'commission_summary_section' WHEN n < 11 THEN 'commission_summary' WHEN n = 11 THEN 'post_summary_section' ELSE 'auxiliary_row' END
      WHEN v = 6 THEN 'auxiliary_row' WHEN v = 9 THEN 'blank_row' WHEN v = 12 THEN 'repeated_header' END AS ignored,
    CASE v WHEN 3 THEN 'date_invalid' WHEN 4 THEN 'debit_credit_conflict' WHEN 5 THEN 'amount_missing' WHEN 7 THEN 'negative_source_amount' WHEN 8 THEN 'formula_unsupported' WHEN 10 THEN 'zero_amount_unsupported' WHEN 11 THEN 'date_unsupported'
      WHEN 1 THEN CASE WHEN o_orderkey % 2 = 1 THEN 'money_scale_exceeded' END WHEN 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'date_outside_period' END END AS rejected FROM o)
  SELECT o_orderkey, CASE WHEN ignored IS NOT NULL THEN 'IGNORED' WHEN rejected IS NOT NULL THEN 'REJECTED' ELSE 'PARSED' END AS outcome, coalesce(ignored, rejected, CASE WHEN v = 0 THEN 'running_balance_invalid' ELSE '' END) AS codes,
    CASE WHEN coalesce(ignored, rejected) IS NULL THEN CAST(CASE v WHEN 0 THEN -floor(t) WHEN 1 THEN t ELSE -t END AS DECIMAL(20,2)) END AS signed_amount, CASE WHEN coalesce(ignored, rejected) IS NULL THEN d END AS date FROM b""")
def current_rows(spark, sf_dir):
    """Orders printed as current-account sheets: a header, thirteen kinds of rows, and from the
    ninth row of a customer on a commission summary."""
    w, k = Window.partitionBy("o_custkey").orderBy("o_orderkey"), F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumns({"n": F.row_number().over(w), "v": k % 13, "d": F.col("o_orderdate").cast("date"), "price": amount("o_totalprice")})
    pick = lambda *cases: F.coalesce(*(F.when(F.col("v").isin(*v), x) for v, x in cases), F.lit(None).cast("string"))
    head = {"A": "Fecha", "C": "Descripción", "E": "Cargos", "F": "Abonos", "G": "Saldo"}
    day, points = F.date_format("d", "dd/MM/yyyy"), F.translate(F.format_number("price", 2), ",.", ".,")
    whole = F.translate(F.format_number(F.floor("price"), 0), ",", ".")
    titles = lambda c: ([12], F.lit(head[c]))
    cells = {
        "A": pick(([0, 1, 4, 5, 7, 8, 10], day), ([2], F.date_format(F.when(k % 5 == 0, F.date_add("d", 10_000)).otherwise(F.col("d")), "dd-MM-yyyy")), ([3], F.date_format("d", "d.M.yyyy")), ([6], F.lit("nota")), ([11], F.lit("45000")), titles("A")),
        "B": F.lit(None).cast("string"), "C": pick(([0, 1, 2, 3, 4, 5, 7, 8, 10, 11], F.lit("movement")), titles("C")), "D": F.lit(None).cast("string"),
        "E": pick(([0, 3, 4, 8, 11], whole), ([2], F.concat(F.lit("$ "), points)), ([7], F.lit("(5)")), ([10], F.lit("0")), titles("E")),
        "F": pick(([1], F.when(k % 2 == 1, F.lit("0.125")).otherwise(F.col("price").cast("string"))), ([4], F.lit("7")), titles("F")),
        "G": pick(([0], F.lit("much")), ([1, 2], F.lit("0")), titles("G")),
    }
    marks = {"A": F.when(F.col("n") == 11, "Mensajes"), "C": F.when(F.col("n") == 9, "Resumen de comisiones")}
    special = F.col("n").isin(9, 11)
    cells = {c: F.when(special, marks.get(c, F.lit(None).cast("string"))).otherwise(x) for c, x in cells.items()}
    kinds = F.create_map(F.lit("F"), F.when(F.col("v") == 1, "n").otherwise("text"), F.lit("A"), F.when(F.col("v") == 11, "n").otherwise("text"))
    rows = orders.select(F.col("o_custkey").alias("source_id"), F.lit(0).alias("sheet_ordinal"), (F.col("n") + 1).alias("row_number"), "o_orderkey", *(x.alias(c) for c, x in cells.items()), kinds.alias("types"), ((F.col("v") == 8) & ~special).alias("has_formula"))
    header = orders.select("o_custkey").distinct().select(F.col("o_custkey").alias("source_id"), F.lit(0).alias("sheet_ordinal"), F.lit(1).alias("row_number"), F.lit(None).cast("long").alias("o_orderkey"), *(F.lit(head.get(c)).cast("string").alias(c) for c in "ABCDEFG"), F.create_map(F.lit("A"), F.lit("text")).alias("types"), F.lit(False).alias("has_formula"))
    periods = orders.groupBy(F.col("o_custkey").alias("source_id")).agg(F.min("d").alias("period_start"), F.max("d").alias("period_end"))
    found = statements.current(rows.unionByName(header), periods).filter("o_orderkey IS NOT NULL")
    return found.select("o_orderkey", "outcome", F.array_join("codes", ",").alias("codes"), "signed_amount", "date")


_PRINTED = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS d, CAST(floor(l_extendedprice) AS BIGINT) AS p, (l_partkey + l_linenumber) % 11 AS v, CAST(o_orderdate AS DATE) AS s,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query(f"""WITH p AS ({_PRINTED}), c AS (SELECT *, CASE v WHEN 1 THEN 'row_geometry_ambiguous' WHEN 2 THEN 'money_precision_overflow' WHEN 3 THEN 'amount_invalid' WHEN 4 THEN 'amount_missing' WHEN 5 THEN 'amount_both_sides' WHEN 6 THEN 'negative_directional_amount' WHEN 7 THEN 'zero_amount_unsupported' WHEN 8 THEN 'running_balance_missing' WHEN 10 THEN 'running_balance_invalid' END AS code,
    v <> 0 AND d BETWEEN s - 1500 AND s + 1500 AS inside FROM p),
  m AS (SELECT *, max(CASE WHEN inside AND code IS NULL THEN d END) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
  r AS (SELECT *, CASE WHEN v = 0 THEN 'date_invalid' WHEN NOT inside THEN 'date_outside_period' WHEN d < before THEN 'date_order_invalid' ELSE code END AS reason FROM m)
  SELECT l_orderkey, n AS line, CASE WHEN reason IS NULL THEN 'PARSED' ELSE 'REJECTED' END AS outcome, coalesce(reason, '') AS codes, CASE WHEN reason IS NULL THEN CAST(-p AS DECIMAL(20,2)) END AS signed_amount FROM r""")
def historical_rows(spark, sf_dir):
    """Line items as rows of printed statements, ten of eleven with a fault of their own."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("s"))
    lines = table(spark, sf_dir, "lineitem").withColumns({"n": F.row_number().over(w), "v": (F.col("l_partkey") + F.col("l_linenumber")) % 11, "p": F.floor("l_extendedprice").cast("string")})
    v, none = F.col("v"), F.lit(None).cast("string")
    rows = lines.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("n").alias("row"), F.col("n").alias("line"), F.when(v == 0, "99/99/2020").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("date"), F.lit("text").alias("description"),
        F.when(v == 1, "1 2").when(v == 2, "9" * 20).when(v.isin(5, 7), "0").when(v.isin(3, 4, 6), none).otherwise(F.col("p")).alias("debit"), F.when(v == 3, "x").when(v == 5, "5").when(v == 6, "-5").otherwise(none).alias("credit"),
        F.when(v == 8, none).when(v == 10, "1.2").otherwise("-1.000").alias("balance"),
    )
    periods = orders.select(F.col("o_orderkey").alias("doc_id"), F.date_sub("s", 1500).alias("period_start"), F.date_add("s", 1500).alias("period_end"))
    found = statements.historical(rows, periods)
    return found.select(F.col("doc_id").alias("l_orderkey"), "line", "outcome", F.array_join("codes", ",").alias("codes"), "signed_amount")


@query(f"""WITH p AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN p ELSE -p END AS a, l_linenumber = 7 AS bad FROM ({_PRINTED})),
  b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY bad, n) AS k, sum(CASE WHEN NOT bad THEN a ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n) + CASE WHEN v = 3 THEN 1 ELSE 0 END AS balance FROM p),
  c AS (SELECT *, coalesce(lag(balance) OVER (PARTITION BY l_orderkey ORDER BY n), CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE 0 END) + a - balance AS off FROM b WHERE NOT bad),
  g AS (SELECT l_orderkey, arg_min(off, n) FILTER (off <> 0) AS c1, sum(CASE WHEN a < 0 THEN -a ELSE 0 END) AS sd, sum(CASE WHEN a > 0 THEN a ELSE 0 END) AS sc, arg_max(balance, n) AS last, count(*) AS k FROM c GROUP BY 1),
  q AS (SELECT l_orderkey, bool_or(bad) AS rejected FROM p GROUP BY 1),
  o AS (SELECT o_orderkey AS import_batch_id, coalesce(rejected, false) AS r, coalesce(k, 0) AS k, coalesce(c1, 0) AS c1, coalesce(sd, 0) AS sd, coalesce(sc, 0) AS sc, last, CASE WHEN o_orderkey % 11 <> 0 THEN 0 END AS opening,
    CASE WHEN o_orderkey % 17 <> 0 THEN coalesce(sc, 0) - coalesce(sd, 0) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END END AS closing, coalesce(sd, 0) + CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END AS debits, CASE WHEN o_orderkey % 13 <> 0 THEN coalesce(sc, 0) END AS credits
    FROM orders LEFT JOIN g ON g.l_orderkey = o_orderkey LEFT JOIN q ON q.l_orderkey = o_orderkey),
  s AS (SELECT *, opening IS NULL OR closing IS NULL OR credits IS NULL AS lacking, CASE WHEN sd <> debits THEN sd - debits ELSE sc - credits END AS off FROM o),
  t AS (SELECT *, CASE WHEN NOT r AND NOT lacking AND k = 0 AND opening = closing AND debits = 0 AND credits = 0 THEN 'PASS' WHEN r OR k = 0 OR opening IS NULL THEN 'INSUFFICIENT_DATA' WHEN c1 = 0 THEN 'PASS' ELSE 'FAIL' END AS s1,
    CASE WHEN lacking THEN 'INSUFFICIENT_DATA' WHEN opening + credits - debits = closing THEN 'PASS' ELSE 'FAIL' END AS s2, CASE WHEN r OR credits IS NULL THEN 'INSUFFICIENT_DATA' WHEN off = 0 THEN 'PASS' ELSE 'FAIL' END AS s3,
    CASE WHEN r OR closing IS NULL THEN 'INSUFFICIENT_DATA' WHEN k = 0 THEN CASE WHEN opening = closing THEN 'PASS' ELSE 'FAIL' END WHEN last = closing THEN 'PASS' ELSE 'FAIL' END AS s4 FROM s)
  SELECT import_batch_id, s1 AS running_balance_continuity, s2 AS summary_balance_equation, s3 AS parsed_totals_match_printed, s4 AS final_running_balance_matches,
    CASE WHEN r OR lacking THEN 'INSUFFICIENT_DATA' WHEN s1 = 'PASS' AND s2 = 'PASS' AND s3 = 'PASS' AND s4 = 'PASS' THEN 'RECONCILED' ELSE 'NOT_RECONCILED' END AS reconciliation_status,
    concat_ws(',', CASE WHEN opening IS NULL THEN 'opening_balance' END, CASE WHEN credits IS NULL THEN 'printed_total_credits' END, CASE WHEN closing IS NULL THEN 'closing_balance' END) AS missing,
    CAST(coalesce(CASE WHEN s1 = 'FAIL' THEN c1 END, CASE WHEN s2 = 'FAIL' THEN opening + credits - debits - closing END, CASE WHEN credits IS NOT NULL AND off <> 0 THEN off END, CASE WHEN s4 = 'FAIL' AND k > 0 THEN last - closing END) AS DECIMAL(38,2)) AS difference FROM t""")
def historical_checks(spark, sf_dir):
    """Orders as printed statements: some balances, totals and closings are off, some operands
    missing, some rows rejected."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    price = F.floor("l_extendedprice").cast(money.MONEY)
    lines = table(spark, sf_dir, "lineitem").withColumns({"ordinal": F.row_number().over(w), "bad": F.col("l_linenumber") == 7, "a": F.when(F.col("l_linenumber") % 3 == 0, price).otherwise(-price), "off": (F.col("l_partkey") + F.col("l_linenumber")) % 11 == 3})
    balance = F.sum(F.when(~F.col("bad"), F.col("a")).otherwise(0)).over(w) + F.when(F.col("off"), 1).otherwise(0)
    rows = lines.select(
        F.col("l_orderkey").alias("import_batch_id"), "ordinal", F.when(F.col("bad"), "REJECTED").otherwise("PARSED").alias("outcome"), F.when(F.col("a") < 0, -F.col("a")).cast(money.MONEY).alias("debit"), F.when(F.col("a") > 0, F.col("a")).cast(money.MONEY).alias("credit"), balance.cast(money.MONEY).alias("balance")
    )
    good = rows.filter("outcome = 'PARSED'").groupBy("import_batch_id").agg(F.coalesce(F.sum("debit"), F.lit(0)).alias("sd"), F.coalesce(F.sum("credit"), F.lit(0)).alias("sc"))
    k, z = F.col("import_batch_id"), lambda c: F.coalesce(F.col(c), F.lit(0))
    batches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("import_batch_id")).join(good, "import_batch_id", "left").select(
        k, F.when(k % 11 != 0, F.lit(0)).cast(money.MONEY).alias("opening"), F.when(k % 17 != 0, z("sc") - z("sd") + F.when(k % 7 == 0, 1).otherwise(0)).cast(money.MONEY).alias("closing"),
        (z("sd") + F.when(k % 5 == 0, 2).otherwise(0)).cast(money.MONEY).alias("debits"), F.when(k % 13 != 0, z("sc")).cast(money.MONEY).alias("credits"),
    )
    found = reconcile.historical_checks(rows, batches)
    return found.select("import_batch_id", *reconcile.CHECKS, "reconciliation_status", F.array_join("missing", ",").alias("missing"), "difference")


@query("""SELECT o_orderkey AS import_batch_id, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN 'INSUFFICIENT_DATA' WHEN o_orderkey % 7 = 0 THEN 'NOT_RECONCILED' ELSE 'RECONCILED' END AS reconciliation_status,
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE 0 END AS DECIMAL(38,2)) END AS difference, CASE WHEN o_orderkey % 5 = 0 THEN 'charges' ELSE '' END AS missing FROM orders""")
def card_equation(spark, sf_dir):
    """Orders as card statements, each with summary lines of five operands, the second of one kind left out."""
    k, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("decimal(20,2)")
    line = lambda name, n, x, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(name).alias("operand"), F.lit(n).alias("line"), F.lit(x).cast("decimal(20,2)").alias("value") if isinstance(x, int) else x.cast("decimal(20,2)").alias("value")))
    lines = [line("previous", 1, v), line("purchases", 2, 100), line("purchases", 3, 999), line("charges", 4, 5, k % 5 != 0), line("payments", 5, -50), line("current", 6, v + 55 + F.when(k % 7 == 0, 1).otherwise(0)), line("rejected_row", 7, 0, k % 11 == 0)]
    rows = table(spark, sf_dir, "orders").select(k.alias("import_batch_id"), F.inline(F.array_compact(F.array(*lines))))
    found = reconcile.card_equation(rows)
    return found.select("import_batch_id", "reconciliation_status", F.col("difference").cast("decimal(38,2)").alias("difference"), F.array_join("missing", ",").alias("missing"))


@query(f"""WITH m AS ({_MOVEMENTS}), p AS (SELECT account_id, import_batch_id, min(occurrence_date) AS s, max(occurrence_date) AS e FROM m GROUP BY 1, 2),
  l AS (SELECT *, lag(e) OVER (PARTITION BY account_id ORDER BY s, e, import_batch_id) AS before FROM p)
  SELECT account_id, import_batch_id, CASE WHEN before IS NULL THEN 'FIRST' WHEN s = before THEN 'TOUCHING' WHEN s = before + 1 THEN 'ADJACENT' WHEN s > before THEN 'GAP' ELSE 'OVERLAP' END AS continuity FROM l""")
def period_continuity(spark, sf_dir):
    """Extension: how each statement's period follows the one before."""
    periods = movements(spark, sf_dir).groupBy("account_id", "import_batch_id").agg(F.min("occurrence_date").alias("s"), F.max("occurrence_date").alias("e"))
    before = F.lag("e").over(Window.partitionBy("account_id").orderBy("s", "e", "import_batch_id"))
    kind = F.when(F.col("b").isNull(), "FIRST").when(F.col("s") == F.col("b"), "TOUCHING").when(F.col("s") == F.date_add("b", 1), "ADJACENT").when(F.col("s") > F.col("b"), "GAP").otherwise("OVERLAP")
    return periods.withColumn("b", before).select("account_id", "import_batch_id", kind.alias("continuity"))


@query("""WITH o AS (SELECT o_orderdate AS d, o_totalprice AS t FROM orders WHERE o_orderkey % 10 <> 0), n AS (SELECT o_orderdate AS d, o_totalprice AS t FROM orders WHERE o_orderkey % 10 <> 1),
  a AS (SELECT d, t, sum(o) AS o, sum(n) AS n FROM (SELECT d, t, 1 AS o, 0 AS n FROM o UNION ALL SELECT d, t, 0, 1 FROM n) GROUP BY 1, 2)
  SELECT CAST(coalesce(sum(least(o, n)), 0) AS BIGINT) AS kept, CAST(coalesce(sum(greatest(n - o, 0)), 0) AS BIGINT) AS added, CAST(coalesce(sum(greatest(o - n, 0)), 0) AS BIGINT) AS dropped FROM a""")
def snapshot_diff(spark, sf_dir):
    """Extension: signatures that two captures share, gained and lost, with multiplicity."""
    orders = table(spark, sf_dir, "orders")
    mark = lambda rows, o, n: rows.select(F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("t"), F.lit(o).alias("o"), F.lit(n).alias("n"))
    both = mark(orders.filter("o_orderkey % 10 <> 0"), 1, 0).unionAll(mark(orders.filter("o_orderkey % 10 <> 1"), 0, 1))
    counts = both.groupBy("d", "t").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    return counts.agg(total(F.least("o", "n")).alias("kept"), total(F.greatest(F.col("n") - F.col("o"), zero)).alias("added"), total(F.greatest(F.col("o") - F.col("n"), zero)).alias("dropped"))


@query(f"""WITH m AS ({_MOVEMENTS}) SELECT account_id, layer, count(*) AS n, CAST(sum(signed_amount) AS DECIMAL(38,2)) AS total FROM (SELECT account_id, 'CANONICAL' AS layer, signed_amount FROM m WHERE line > 2 UNION ALL SELECT account_id, 'PROVISIONAL', signed_amount FROM m WHERE line <= 2) GROUP BY 1, 2""")
def provisional_view(spark, sf_dir):
    """Extension: canonical movements and unresolved observations, apart by layer."""
    rows = movements(spark, sf_dir).select("account_id", "line", "signed_amount")
    both = rows.filter("line > 2").withColumn("layer", F.lit("CANONICAL")).unionByName(rows.filter("line <= 2").withColumn("layer", F.lit("PROVISIONAL")))
    return both.groupBy("account_id", "layer").agg(F.count("*").alias("n"), F.sum("signed_amount").cast("decimal(38,2)").alias("total"))


@query("""SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) = count(*) AS ordinals_distinct, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS consensus,
    array_to_string(list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(list(l_returnflag), x))), ',') AS missing FROM lineitem GROUP BY 1""")
def batch_guards(spark, sf_dir):
    """Distinct ordinals, consensus of a value, and operands that are missing."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("o"), F.collect_set("l_returnflag").alias("f"))
    missing = F.array_except(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("f"))
    return rows.select("l_orderkey", F.size("o").cast("long").alias("n"), (F.size(F.array_distinct("o")) == F.size("o")).alias("ordinals_distinct"), F.when(F.size("f") == 1, F.get("f", F.lit(0))).alias("consensus"), F.array_join(missing, ",").alias("missing"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN '+' ELSE '−' END || regexp_replace(replace(replace(replace(format('{:,.2f}', l_extendedprice), ',', '#'), '.', ','), '#', '.'), ',00$', '') AS shown FROM lineitem""")
def money_shown(spark, sf_dir):
    signed = F.when(F.col("l_returnflag") == "R", amount("l_extendedprice")).otherwise(-amount("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", money.shown(signed).alias("shown"))
