"""Registered queries of claims, guards, bindings and validation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import money
from quillon.operators import constraints, evidence, reconcile, report, validation
from quillon.plans.catalogue import _MOVEMENTS, accounts, amount, movements, query, records, table



def order_key() -> Column:
    return F.col("o_orderkey")


#: Claims of orders, with all eight fields.
_CLAIM_SQL = """SELECT o_orderkey AS observation_id, CAST(o_orderdate AS DATE) AS accounting_date, CAST(o_totalprice AS DECIMAL(20,2)) AS signed_amount FROM orders"""


def claimed(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        order_key().alias("observation_id"), F.lit(None).cast("date").alias("transaction_date"), F.col("o_orderdate").cast("date").alias("accounting_date"), amount("o_totalprice").alias("signed_amount"),
        F.lit("CLP").alias("currency"), F.col("o_orderpriority").alias("description"), F.lit(None).cast("string").alias("source_reference"), F.lit("method").alias("interpretation_method"), F.lit("v1").alias("interpretation_version"), *more,
    )


@query("""SELECT o_orderkey AS observation_id, attempt, decision FROM (SELECT o_orderkey, 1 AS attempt, 'CREATED' AS decision FROM orders UNION ALL SELECT o_orderkey, 2, 'RETRIED' FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 3, 'observation_idempotency_conflict' FROM orders WHERE o_orderkey % 4 = 0)""")
def observation_claims(spark, sf_dir):
    """Attempts to create observations: some are repeated, some again with another amount."""
    rows = claimed(spark, sf_dir)
    at = lambda n, r: r.withColumn("attempt", F.lit(n))
    other = rows.filter("observation_id % 4 = 0").withColumn("signed_amount", (F.col("signed_amount") + 1).cast(money.MONEY))
    return evidence.claims(at(1, rows).unionByName(at(2, rows.filter("observation_id % 3 = 0"))).unionByName(at(3, other))).select("observation_id", "attempt", "decision")


@query("""SELECT o_orderkey AS observation_id, o_custkey AS import_batch_id, o_custkey % 5 <> 0 AND o_custkey % 7 <> 0 AND o_orderstatus <> 'P' AND o_orderkey % 17 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0 AND o_orderkey % 31 <> 0 AS eligible, o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0 AS balanced FROM orders""")
def policy_eligible(spark, sf_dir):
    """Which claims the automatic policy may confirm: some batches are partial or not
    reconciled, some claims resolved, some without evidence or with another amount."""
    rows = claimed(spark, sf_dir, order_key().alias("raw_record_id"), F.when(F.col("o_orderstatus") == "P", "RESOLVED").otherwise("UNRESOLVED").alias("state"))
    rows = rows.withColumns({"interpretation_method": F.when(F.col("observation_id") % 19 == 0, "other").otherwise("method"), "interpretation_version": F.when(F.col("observation_id") % 23 == 0, "v2").otherwise("v1"), "transaction_date": F.when(F.col("observation_id") % 29 == 0, F.col("accounting_date"))})
    orders = table(spark, sf_dir, "orders")
    raw = orders.select(order_key().alias("raw_record_id"), F.col("o_custkey").alias("import_batch_id"), F.when(order_key() % 17 == 0, "REJECTED").otherwise("PARSED").alias("parse_outcome"))
    b = F.col("c_custkey")
    batches = table(spark, sf_dir, "customer").select(b.alias("import_batch_id"), F.when(b % 5 == 0, "PARTIAL").otherwise("ACCEPTED").alias("status"), F.when(b % 7 == 0, "NOT_RECONCILED").otherwise("RECONCILED").alias("reconciliation_status"))
    proof = orders.filter(order_key() % 11 != 0).select(order_key().alias("raw_record_id"), F.when(order_key() % 31 == 0, F.col("o_orderdate").cast("date")).alias("transaction_date"), F.col("o_orderdate").cast("date").alias("accounting_date"), (amount("o_totalprice") + F.when(order_key() % 13 == 0, 1).otherwise(0)).cast(money.MONEY).alias("signed_amount"), F.lit("CLP").alias("currency"), F.when(order_key() % 3 != 0, amount("o_totalprice")).alias("running_balance"))
    return evidence.eligible(rows, raw, batches, proof).select("observation_id", "import_batch_id", "eligible", "balanced")


_LEDGER = "SELECT o_orderkey AS k, o_custkey % 20 AS account_id, CAST(date_trunc('year', o_orderdate) AS DATE) AS d, CAST(floor(o_totalprice / 100000) AS INTEGER) AS a FROM orders"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(order_key().alias("k"), (F.col("o_custkey") % 20).alias("account_id"), F.trunc("o_orderdate", "year").alias("occurrence_date"), F.floor(F.col("o_totalprice") / 100000).cast("int").alias("signed_amount"), F.lit("CLP").alias("currency"))


@query(f"""WITH l AS ({_LEDGER}), m AS (SELECT *, CASE WHEN k % 10 = 1 THEN k - 1 ELSE k END AS raw FROM l WHERE k % 16 = 1 OR k % 10 = 1), c AS (SELECT * FROM l WHERE k % 2 = 0),
  g AS (SELECT account_id, d, a, list_sort(list(DISTINCT raw)) AS candidates FROM m GROUP BY ALL),
  r AS (SELECT c.k, k % 12 = 0 AS undated, c.k IN (SELECT raw FROM m) AS origin, candidates, k % 4 = 0 AND (k % 8 = 0 OR candidates = [k + 1]) AS allowed FROM c LEFT JOIN g USING (account_id, d, a))
  SELECT k AS observation_id, CASE WHEN undated THEN 'movement_date_mismatch' WHEN origin THEN 'origin_movement_exists' WHEN candidates IS NOT NULL AND NOT allowed THEN 'movement_candidate_exists' END AS code FROM r""")
def confirm_guard(spark, sf_dir):
    """CONFIRM_NEW of every second order against movements of others."""
    rows, k = _ledger(spark, sf_dir), F.col("k")
    made = rows.filter((k % 16 == 1) | (k % 10 == 1)).withColumn("raw_record_id", F.when(k % 10 == 1, k - 1).otherwise(k))
    commands = rows.filter(k % 2 == 0).select(
        k.alias("observation_id"), k.alias("raw_record_id"), "account_id", "occurrence_date", "signed_amount", "currency", F.when(k % 3 != 0, F.col("occurrence_date")).alias("transaction_date"),
        F.when(k % 12 == 0, F.date_add("occurrence_date", 1)).when(k % 3 == 0, F.col("occurrence_date")).alias("accounting_date"), (k % 4 == 0).alias("allow_exact_collision"), F.when(k % 8 != 0, F.array(k + 1)).alias("allowed_raw_record_ids"),
    )
    return evidence.confirm_guard(commands, made)


@query(f"""WITH l AS ({_LEDGER}), m AS (SELECT k AS movement_id, account_id, a, CASE WHEN k % 5 = 0 THEN k + 1 ELSE k END AS raw, CASE WHEN k % 9 = 0 THEN 'USD' ELSE 'CLP' END AS cur FROM l),
  o AS (SELECT raw, min(movement_id) AS origin FROM m GROUP BY 1), c AS (SELECT *, CASE WHEN k % 7 = 0 THEN -k WHEN k % 4 = 0 THEN k + 1 ELSE k END AS to FROM l)
  SELECT c.k AS observation_id, CASE WHEN m.movement_id IS NULL THEN 'movement_not_found' WHEN m.account_id <> c.account_id THEN 'movement_account_mismatch' WHEN cur <> 'CLP' THEN 'movement_currency_mismatch' WHEN m.a <> c.a THEN 'movement_amount_mismatch' WHEN origin <> movement_id THEN 'origin_movement_mismatch' END AS code
  FROM c LEFT JOIN m ON m.movement_id = c.to LEFT JOIN o ON o.raw = c.k""")
def match_guard(spark, sf_dir):
    """MATCH_EXISTING of orders with their own movement, the next one, or none."""
    rows, k = _ledger(spark, sf_dir), F.col("k")
    made = rows.select(k.alias("movement_id"), "account_id", "signed_amount", F.when(k % 9 == 0, "USD").otherwise("CLP").alias("currency"), F.when(k % 5 == 0, k + 1).otherwise(k).alias("raw_record_id"))
    commands = rows.select(k.alias("observation_id"), k.alias("raw_record_id"), "account_id", "signed_amount", "currency", F.when(k % 7 == 0, -k).when(k % 4 == 0, k + 1).otherwise(k).alias("movement_id"))
    return evidence.match_guard(commands, made)


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey // 4 AS raw, o_orderkey // 3 AS a, o_orderkey % 6 = 5 AS old FROM orders),
  c AS (SELECT k, CASE WHEN k % 10 = 0 THEN k WHEN k % 14 = 0 THEN -k WHEN k % 2 = 0 THEN k + 1 ELSE k + 2 END AS s FROM o WHERE k % 2 = 0 OR k % 5 = 0), e AS (SELECT c.k, c.s, CASE WHEN t.k IS NULL THEN 'successor_observation_not_found' WHEN t.k // 32 <> o.k // 32 THEN 'successor_account_mismatch' WHEN c.s = c.k THEN 'successor_observation_same' WHEN t.raw <> o.raw THEN 'successor_raw_record_mismatch' WHEN t.old THEN 'successor_not_fresh' WHEN c.s % 21 = 1 THEN 'successor_already_used' END AS early,
    t.a = o.a AS same FROM c JOIN o ON o.k = c.k LEFT JOIN o AS t ON t.k = c.s), u AS (SELECT s, min(k) AS by FROM e WHERE early IS NULL AND NOT same GROUP BY 1)
  SELECT k AS observation_id, e.s AS successor_id, coalesce(early, CASE WHEN u.by < k THEN 'successor_already_used' WHEN same THEN 'successor_claim_unchanged' END) AS code FROM e LEFT JOIN u ON u.s = e.s""")
def supersede_guard(spark, sf_dir):
    """Orders that are to be superseded by one of the next, four of them to a row."""
    rows = claimed(spark, sf_dir).withColumns({"raw_record_id": F.floor(F.col("observation_id") / 4), "account_id": F.floor(F.col("observation_id") / 32), "state": F.when(F.col("observation_id") % 6 == 5, "RESOLVED").otherwise("UNRESOLVED"), "state_version": (F.col("observation_id") % 6 == 5).cast("int"), "signed_amount": F.floor(F.col("observation_id") / 3).cast(money.MONEY), "description": F.lit("d"), "accounting_date": F.lit(None).cast("date")})
    k = F.col("observation_id")
    commands = rows.filter((k % 2 == 0) | (k % 5 == 0)).select(k, F.when(k % 10 == 0, k).when(k % 14 == 0, -k).when(k % 2 == 0, k + 1).otherwise(k + 2).alias("successor_id"))
    used = rows.filter(k % 21 == 1).select(k.alias("successor_id"))
    return evidence.supersede_guard(commands, rows, used)


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN 'account_incompatible' WHEN c_custkey % 9 = 0 THEN 'card_suffix_invalid' END AS code FROM customer)
  SELECT k AS account_id, 1 AS request, coalesce(code, 'CREATED') AS decision FROM c UNION ALL SELECT k, 2, coalesce(code, 'UNCHANGED') FROM c WHERE k % 8 = 0
  UNION ALL SELECT k, 3, CASE WHEN k % 4 <> 0 THEN code WHEN code IS NULL THEN 'account_binding_conflict' ELSE 'CREATED' END FROM c WHERE k % 3 = 0""")
def card_bindings(spark, sf_dir):
    """Requests to bind customers to cards: some again, some to another card."""
    held, k = accounts(spark, sf_dir), F.col("account_id")
    suffix = lambda n: F.lpad(((k + n) % 10000).cast("string"), 4, "0")
    first = held.withColumn("card_last_four", F.when(k % 9 == 0, "12x4").otherwise(suffix(0)))
    at = lambda n, r: r.withColumn("request", F.lit(n))
    every = at(1, first).unionByName(at(2, first.filter(k % 8 == 0))).unionByName(at(3, held.filter(k % 3 == 0).withColumn("card_last_four", suffix(1))))
    return evidence.bindings(every).select("account_id", "request", "decision")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN 'account_binding_missing' WHEN o_orderkey % 6 = 0 OR o_orderkey % 7 = 0 THEN 'card_binding_mismatch' END AS code FROM orders""")
def card_statements(spark, sf_dir):
    """Orders as card statements, of which some show another card or none."""
    k = F.col("account_id")
    held = accounts(spark, sf_dir).filter("kind = 'CREDIT_CARD'").select(k, F.lpad((k % 10000).cast("string"), 4, "0").alias("card_last_four"))
    shown = F.when(order_key() % 7 == 0, F.lit(None).cast("string")).otherwise(F.lpad(((F.col("o_custkey") + F.when(order_key() % 6 == 0, 1).otherwise(0)) % 10000).cast("string"), 4, "0"))
    rows = table(spark, sf_dir, "orders").select(order_key(), F.col("o_custkey").alias("account_id"), shown.alias("card_last_four"))
    return evidence.bound(rows, held).select("o_orderkey", "code")


#: Parser codes that may be told outside, and what they are called there.
PUBLIC = {"movement_header_not_found": "unsupported_layout", "period_context_missing": "period_missing", "formula_unsupported": "formula_unsupported"}


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'unsupported_layout' WHEN 1 THEN 'period_missing' WHEN 2 THEN 'formula_unsupported' WHEN 3 THEN 'parser_unexpected' END AS public_code FROM orders""")
def failure_codes(spark, sf_dir):
    code = F.when(order_key() % 5 == 0, "movement_header_not_found").when(order_key() % 5 == 1, "period_context_missing").when(order_key() % 5 == 2, "formula_unsupported").when(order_key() % 5 == 3, "secret detail")
    return evidence.public_codes(table(spark, sf_dir, "orders").select(order_key(), code.alias("code")), PUBLIC).select("o_orderkey", "public_code")


@query("""WITH l AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'A') AS p, count(*) FILTER (l_returnflag = 'A' AND l_partkey % 50 <> 0) AS m FROM lineitem GROUP BY 1) SELECT k AS import_batch_id, p AS parsed, m AS movements FROM l WHERE p <> m""")
def movement_count_check(spark, sf_dir):
    """Batches of which a parsed row made no movement."""
    made = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A' AND l_partkey % 50 <> 0").select(F.col("l_orderkey").alias("import_batch_id"))
    return validation.movement_counts(reconcile.batch_status(records(spark, sf_dir)), made)


@query("""SELECT l_orderkey, min(CAST(l_linenumber * 10 AS DECIMAL(10,2))) AS x0, CAST(min(l_quantity) AS DECIMAL(10,2)) AS y0, max(CAST(l_linenumber * 10 + 9 AS DECIMAL(10,2))) AS x1, CAST(max(l_quantity + 8) AS DECIMAL(10,2)) AS y1 FROM lineitem GROUP BY 1""")
def token_boxes(spark, sf_dir):
    """Line items as tokens of a page: the box around all of an order."""
    point = lambda c: c.cast("decimal(10,2)")
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", point(n * 10).alias("x0"), point(q).alias("y0"), point(n * 10 + 9).alias("x1"), point(q + 8).alias("y1"))
    return evidence.union_boxes(rows, "l_orderkey")


_ROWS = "l_linenumber, l_partkey, l_suppkey, l_shipdate"


@query(f"""WITH s AS (SELECT *, row_number() OVER w AS record_ordinal, count(*) FILTER (l_returnflag = 'R') OVER w AS section FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ROWS} ROWS UNBOUNDED PRECEDING))
  SELECT l_orderkey, record_ordinal, section, row_number() OVER (PARTITION BY l_orderkey, section ORDER BY record_ordinal) AS section_ordinal FROM s""")
def section_ordinals(spark, sf_dir):
    """Rows with the flag R are headings of sections."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *_ROWS.split(", "))
    return evidence.section_ordinals(rows, F.col("l_returnflag") == "R", "l_orderkey", _ROWS.split(", ")).select("l_orderkey", "record_ordinal", "section", "section_ordinal")


@query("""SELECT l_orderkey, sha256(CAST(to_json(list({'line': l_linenumber, 'part': l_partkey, 'flag': l_returnflag} ORDER BY l_linenumber, l_partkey, l_returnflag)) AS VARCHAR)) AS fingerprint FROM lineitem GROUP BY 1""")
def extraction_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
    return evidence.fingerprint(rows, "l_orderkey", "line", "part", "flag")


@query("""WITH l AS (SELECT l_orderkey AS k, l_returnflag AS f, l_partkey % 40 AS v FROM lineitem), g AS (SELECT k, count(*) AS n, count(*) FILTER (f = 'A') AS p, bool_or(v = 1 AND f <> 'A') AS uncoded, bool_or(v = 2) AS amounts, bool_or(v = 3 AND f = 'A') AS zeros FROM l GROUP BY 1)
  SELECT 'row_numbers_contiguous' AS constraint_name, CAST(k AS VARCHAR) AS key FROM g WHERE k % 19 = 0 UNION ALL SELECT 'codes_match_outcome', CAST(k AS VARCHAR) FROM g WHERE uncoded UNION ALL SELECT 'amount_matches_outcome', CAST(k AS VARCHAR) FROM g WHERE amounts
  UNION ALL SELECT 'amount_not_zero', CAST(k AS VARCHAR) FROM g WHERE zeros UNION ALL SELECT 'counts_match', CAST(k AS VARCHAR) FROM g WHERE k % 7 = 0""")
def result_violations(spark, sf_dir):
    """Line items as a parser's rows, some with a fault, against counts that are off for every seventh order."""
    # by the name that all that follows goes by, so that rows are dealt out once; values are added behind the sort
    w, v, parsed = Window.partitionBy("import_batch_id").orderBy(*_ROWS.split(", ")), F.col("l_partkey") % 40, F.col("l_returnflag") == "A"
    outcome = F.when(parsed, "PARSED").when(F.col("l_returnflag") == "N", "IGNORED").otherwise("REJECTED")
    value = F.when(v == 3, F.lit(0).cast(money.MONEY)).otherwise(amount("l_extendedprice"))
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "import_batch_id").withColumn("n", F.row_number().over(w))
    rows = lines.select(
        "import_batch_id", (F.col("n") + F.when(F.col("import_batch_id") % 19 == 0, 1).otherwise(0)).alias("row_number"), outcome.alias("outcome"),
        F.when(parsed | (v == 1), F.array().cast("array<string>")).otherwise(F.array(F.lit("some_code"))).alias("codes"), F.when(parsed != (v == 2), value).alias("signed_amount"),
    )
    # zero amounts count only where they belong
    rows = rows.withColumn("signed_amount", F.when((F.col("outcome") != "PARSED") & (F.col("signed_amount") == 0), F.lit(1).cast(money.MONEY)).otherwise(F.col("signed_amount")))
    counts = reconcile.batch_status(records(spark, sf_dir)).withColumn("parsed", F.col("parsed") + F.when(F.col("import_batch_id") % 7 == 0, 1).otherwise(0))
    return validation.result_graph(rows, counts)


@query(f"""WITH m AS ({_MOVEMENTS}), g AS (SELECT account_id AS k, count(*) AS n, count(DISTINCT movement_id) AS ids FROM m GROUP BY 1)
  SELECT 'count_matches' AS constraint_name, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'total_matches', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 10 = 0
  UNION ALL SELECT 'ids_unique', CAST(k AS VARCHAR) FROM g WHERE ids <> n""")
def report_contract(spark, sf_dir):
    """Reports with amounts and days as texts against envelopes of which some are off."""
    rows = movements(spark, sf_dir).select("account_id", "movement_id", F.col("signed_amount").cast("string").alias("signed_amount"), F.col("occurrence_date").cast("string").alias("occurrence_date"))
    k = F.col("account_id")
    totals = report.account_totals(accounts(spark, sf_dir), movements(spark, sf_dir))
    off = totals.withColumns({"movement_count": F.col("movement_count") + F.when(k % 9 == 0, 1).otherwise(0), "net_signed_amount": F.col("net_signed_amount") + F.when(k % 10 == 0, 1).otherwise(0)})
    return validation.report_contract(rows, off)


@query(f"""WITH m AS ({_MOVEMENTS}) SELECT movement_id, import_batch_id, o_custkey AS source_artifact_id, 'XLSX' AS source_kind, o_orderstatus AS import_status, CAST(signed_amount AS VARCHAR) AS signed_amount FROM m JOIN orders ON import_batch_id = o_orderkey""")
def traced_report(spark, sf_dir):
    """Movements with where they come from; amounts as texts that keep their scale."""
    rows = movements(spark, sf_dir).withColumn("raw_record_id", F.xxhash64("movement_id", "occurrence_date", "signed_amount", "l_quantity", "l_suppkey"))
    raw = rows.select("raw_record_id", "import_batch_id").distinct()
    batches = table(spark, sf_dir, "orders").select(order_key().alias("import_batch_id"), F.col("o_custkey").alias("source_artifact_id"), F.lit("XLSX").alias("source_kind"), F.col("o_orderstatus").alias("import_status"), F.lit("RECONCILED").alias("reconciliation_status"))
    found = report.traced(rows.drop("import_batch_id"), raw, batches)
    return found.select("movement_id", "import_batch_id", "source_artifact_id", "source_kind", "import_status", F.col("signed_amount").cast("string").alias("signed_amount"))


@query("""SELECT 'observation_not_zero' AS constraint_name, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'observation_dated', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 51 = 0
  UNION ALL SELECT 'observation_movement_by_state', CAST(o_orderkey AS VARCHAR) FROM orders WHERE (o_orderstatus = 'F') <> (o_orderkey % 3 = 0) UNION ALL SELECT 'observation_currency', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 52 = 0
  UNION ALL SELECT 'resolution_shape', CAST(event_id AS VARCHAR) FROM events WHERE CASE event_type WHEN 'click' THEN event_id % 4 = 0 WHEN 'view' THEN event_id % 4 = 0 WHEN 'signup' THEN event_id % 4 = 0 WHEN 'error' THEN event_id % 4 <> 0 ELSE true END
  UNION ALL SELECT 'resolution_sequence', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 60 = 0
  UNION ALL SELECT 'artifact_digest_shape', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'movement_not_zero', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_partkey % 30 = 0 UNION ALL SELECT 'movement_of_parsed', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag <> 'A'
  UNION ALL SELECT 'category_name', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT 'classification_revision', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size % 7 = 0 UNION ALL SELECT 'classification_manual', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 11 = 0
  UNION ALL SELECT 'attempt_failure_by_status', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 8 = 0 UNION ALL SELECT 'attempt_duplicate_by_status', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'attempt_duplicate_not_self', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 9 = 0
  UNION ALL SELECT 'attempt_kind_known', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 10 = 0""")
def table_violations(spark, sf_dir):
    """Constraints of seven more tables, each broken on purpose by some rows."""
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    cut = lambda n, c: F.when(order_key() % n != 0, c)
    seen = orders.select(order_key(), F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("UNRESOLVED").alias("state"), F.when(order_key() % 50 == 0, 0).otherwise(1).alias("signed_amount"), F.lit(None).cast("date").alias("transaction_date"), cut(51, F.col("o_orderdate").cast("date")).alias("accounting_date"), F.when(order_key() % 3 == 0, order_key()).alias("current_movement_id"), F.when(order_key() % 52 == 0, "clp").otherwise("CLP").alias("currency"))
    e, actions = F.col("event_id"), {"click": "CONFIRM_NEW", "view": "MATCH_EXISTING", "signup": "MARK_CONFLICT", "error": "REJECT", "purchase": "SUPERSEDE"}
    log = events.select(e, F.col("user_id").alias("observation_id"), F.create_map(*(F.lit(x) for kv in actions.items() for x in kv))[F.col("event_type")].alias("action"), F.lit("UNRESOLVED").alias("from_state"), F.when(e % 4 != 0, e).alias("movement_id"), F.lit(None).cast("long").alias("successor_id"), F.when(e % 60 == 0, 0).otherwise(1).alias("sequence"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")).select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.upper(F.concat(F.lit("G"), F.substring("h", 2, 63)))).otherwise(F.sha2(F.coalesce("h", F.lit("")), 256)).alias("digest"))
    made = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 30 == 0, 0).otherwise(1).alias("signed_amount"), F.lit("CLP").alias("currency"), F.when(F.col("l_returnflag") == "A", "PARSED").otherwise("REJECTED").alias("parse_outcome"))
    p = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(p, F.when(p % 6 == 0, F.concat(F.lit(" "), "p_type")).otherwise(F.col("p_type")).alias("display_name"), F.when(p % 11 == 0, "RULE").otherwise("MANUAL").alias("source"), (F.col("p_size") % 7).alias("revision"))
    tries = orders.select(order_key(), F.lit("ACCEPTED").alias("status"), F.when(order_key() % 8 == 0, "x").alias("failure_code"), F.when(order_key() % 9 == 0, order_key()).alias("duplicate_of"), order_key().alias("attempt_id"), order_key().alias("completed_at"), F.when(order_key() % 10 == 0, "CSV").otherwise("XLSX").alias("source_kind"))
    broken = constraints.broken
    return constraints.every(
        broken(seen, "o_orderkey", **validation.observation_rules()), broken(log, "event_id", **validation.resolution_rules()), broken(docs, "doc_id", **validation.artifact_rules()), broken(made, "l_orderkey", **validation.movement_rules()),
        broken(parts, "p_partkey", **validation.category_rules(), **validation.classification_rules()), broken(tries, "o_orderkey", **validation.attempt_rules()),
    )
