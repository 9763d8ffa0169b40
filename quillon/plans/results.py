"""Registered queries of provenance, results' validation, backfills and authorised reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import backfill, constraints, provenance, report, validation
from quillon.plans.catalogue import _MOVEMENTS, accounts, movements, query, table

#: A payload without fault, and what each fault puts in place of a part of it, with its code.
_GOOD = '{"schema":"field-provenance-v1","fields":{"amount":{"page_ordinal":1,"line_ordinals":[1,2],"token_ordinals":[3],"bbox":["10.00","20.00","30.50","40.00"],"page_width":"612.00","page_height":"792.00","normalized_bbox":["0.016340","0.025253","0.049837","0.050505"],"role":"value","band_relation":"inside","additional_page_spans":[]}}}'
_SPAN = '{"page_ordinal":2,"line_ordinals":[1],"token_ordinals":[1],"bbox":["1","2","3","4"],"page_width":"612","page_height":"792","normalized_bbox":["0","0","0.5","0.5"]}'
_FAULTS = [
    ("", "", None, None), ('"schema":"field-provenance-v1"', '"schema":"v2"', "provenance_schema_unsupported", None), ('"schema":"field-provenance-v1",', "", "provenance_payload_invalid", None), ('"fields":{', '"fields":{"', "provenance_payload_invalid", None),
    ('"amount":', '"":', "provenance_field_name_invalid", ""), ('"role":"value",', "", "provenance_field_invalid", "amount"), ('"page_ordinal":1', '"page_ordinal":1.5', "provenance_field_invalid", "amount"), ('"page_ordinal":1', '"page_ordinal":0', "provenance_ordinal_invalid", "amount"),
    ("[1,2]", "[1,1]", "provenance_ordinals_invalid", "amount"), ("[1,2]", "[0,2]", "provenance_ordinals_invalid", "amount"), ("[3]", "[3.0]", "provenance_field_invalid", "amount"), ('"30.50"', '"30.5e0"', "provenance_decimal_invalid", "amount"), ('"30.50"', "30.50", "provenance_field_invalid", "amount"),
    ('"10.00"', '"31.00"', "provenance_bbox_invalid", "amount"), ('"30.50"', '"613.00"', "provenance_bbox_invalid", "amount"), ('"612.00"', '"0.00"', "provenance_dimension_invalid", "amount"), ('"0.049837"', '"1.000001"', "provenance_normalized_bbox_invalid", "amount"), (',"0.050505"', "", "provenance_normalized_bbox_invalid", "amount"),
    ('"role":"value"', '"role":""', "provenance_text_invalid", "amount"), ("spans\":[]", f'spans":[{_SPAN}]', None, None), ("spans\":[]", f'spans":[{_SPAN},{_SPAN}]', "provenance_spans_invalid", "amount"), ("spans\":[]", f'spans":[{_SPAN.replace(chr(34) + "page_ordinal" + chr(34) + ":2", chr(34) + "page_ordinal" + chr(34) + ":1")}]', "provenance_spans_invalid", "amount"),
    ("spans\":[]", f'spans":[{_SPAN.replace("[1]", "[]", 1)}]', "provenance_field_invalid", "amount"), ("spans\":[]", f'spans":[{_SPAN.replace("0.5", "1.5", 1)}]', "provenance_normalized_bbox_invalid", "amount"), ("}}}", '},"other":{"page_ordinal":1}}}', "provenance_field_invalid", "other"),
]
_CODES = " ".join(f"WHEN {k} THEN '{code}'" for k, (_, _, code, _) in enumerate(_FAULTS) if code)
_FIELDS = " ".join(f"WHEN {k} THEN '{field}'" for k, (_, _, _, field) in enumerate(_FAULTS) if field is not None)


@query(f"""SELECT o_orderkey, CASE o_orderkey % {len(_FAULTS)} {_FIELDS} END AS field, CASE o_orderkey % {len(_FAULTS)} {_CODES} END AS code FROM orders WHERE CASE o_orderkey % {len(_FAULTS)} {_CODES} END IS NOT NULL""")
def provenance_violations(spark, sf_dir):
    """Every order has a payload, most with a fault of their own."""
    k = F.col("o_orderkey") % len(_FAULTS)
    json = F.element_at(F.array(*(F.lit(_GOOD.replace(a, b) if a else _GOOD) for a, b, _, _ in _FAULTS)), (k + 1).cast("int"))
    return provenance.violations(table(spark, sf_dir, "orders").select("o_orderkey", json.alias("provenance")), "o_orderkey")


@query("""WITH t AS (SELECT l_orderkey AS k, l_returnflag AS f, l_linenumber AS n, l_linestatus = 'O' AS two FROM lineitem),
  s AS (SELECT k, f, CASE WHEN two THEN 2 ELSE 1 END AS page, list_sort(list(DISTINCT n)) AS lines, list_sort(list(DISTINCT n * 2)) AS toks, CAST(min(n * 10) AS DECIMAL(20,2)) AS a, CAST(max(n * 10 + 8) AS DECIMAL(20,2)) AS c FROM t GROUP BY ALL),
  q AS (SELECT *, '{"page_ordinal":' || page || ',"line_ordinals":' || to_json(lines) || ',"token_ordinals":' || to_json(toks) || ',"bbox":["' || a || '","5.00","' || c || '","13.00"],"page_width":"612.00","page_height":"792.00"' AS head,
    CAST(round(CAST(a AS DECIMAL(20,10)) / 612, 6) AS DECIMAL(8,6)) AS na, CAST(round(CAST(c AS DECIMAL(20,10)) / 612, 6) AS DECIMAL(8,6)) AS nc FROM s),
  w AS (SELECT k, f, list(head || ',"normalized_bbox":["' || na || '","0.006313","' || nc || '","0.016414"]' ORDER BY page) AS spans FROM q GROUP BY ALL),
  r AS (SELECT k, f, '"' || f || '":' || spans[1] || ',"role":"value","band_relation":"' || CASE WHEN len(spans) > 1 THEN 'across_pages' ELSE 'inside' END || '","additional_page_spans":[' || array_to_string(list_transform(spans[2:], lambda x: x || '}'), ',') || ']}' AS one FROM w)
  SELECT k AS l_orderkey, '{"schema":"field-provenance-v1","fields":{' || string_agg(one, ',' ORDER BY f) || '}}' AS provenance FROM r GROUP BY k""")
def field_provenance(spark, sf_dir):
    """Line items as tokens of three fields, on one page or two."""
    n, point = F.col("l_linenumber"), lambda c: c.cast("decimal(20,2)")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("field"), F.lit("value").alias("role"), F.when(F.col("l_linestatus") == "O", 2).otherwise(1).alias("page"), n.alias("line"), (n * 2).alias("ordinal"), point(n * 10).alias("x0"), point(F.lit(5)).alias("y0"), point(n * 10 + 8).alias("x1"), point(F.lit(13)).alias("y1"),
        point(F.lit(612)).alias("width"), point(F.lit(792)).alias("height"),
    )
    return provenance.fields(rows, "l_orderkey")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 12 AS v FROM orders)
  SELECT CASE v WHEN 1 THEN 'card_status_known' WHEN 2 THEN 'card_missing_known' WHEN 3 THEN 'card_equation' WHEN 4 THEN 'card_equation' WHEN 5 THEN 'card_insufficient' WHEN 6 THEN 'card_not_applicable' WHEN 7 THEN 'card_rejected_row' WHEN 8 THEN 'card_period' WHEN 9 THEN 'card_suffix' WHEN 10 THEN 'card_currency' END AS constraint_name, CAST(k AS VARCHAR) AS key FROM o WHERE v BETWEEN 1 AND 10
  UNION ALL SELECT 'card_insufficient', CAST(k AS VARCHAR) FROM o WHERE v = 2""")
def card_result_violations(spark, sf_dir):
    """Orders as results of card statements, most with one fault."""
    v = F.col("o_orderkey") % 12
    names = list(validation.CARD_OPERANDS)
    lacks = v.isin(2, 5, 11)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(v == 1, "MAYBE").when(lacks, "INSUFFICIENT_DATA").when(v == 6, "NOT_APPLICABLE").when(v == 4, "NOT_RECONCILED").otherwise("RECONCILED").alias("reconciliation_status"),
        F.when((v == 3) | (v == 6), 1).when(~lacks, 0).alias("difference"), F.when(v == 2, F.array(F.lit("other"))).when(v == 11, F.array(F.lit(names[0]))).otherwise(F.array().cast("array<string>")).alias("missing"),
        F.when(~lacks, 10).alias(names[0]), *(F.lit(x).alias(n) for n, x in zip(names[1:], (5, 1, 6, 10), strict=True)), F.when(v == 7, 1).otherwise(0).alias("billed_rejected"),
        F.when(v == 8, "2024-02-01").otherwise("2024-01-01").alias("period_start"), F.lit("2024-01-31").alias("period_end"), F.lit("2024-01-31").alias("cutoff_date"), F.lit("2024-02-10").alias("due_date"), F.when(v == 9, "12a4").otherwise("1234").alias("card_last_four"),
        F.when(v == 10, "USD").when(v != 0, "CLP").alias("statement_currency"), F.lit("CLP").alias("account_currency"),
    )
    return constraints.broken(rows, "o_orderkey", **validation.card_result_rules())


@query("""WITH l AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, l_partkey % 10 AS v, l_returnflag = 'R' AS paid FROM lineitem)
  SELECT CASE v WHEN 1 THEN 'card_original_pair' WHEN 2 THEN 'card_installment' WHEN 3 THEN 'card_unbilled_parsed' WHEN 4 THEN 'card_parsed_record' WHEN 5 THEN 'card_debt_effect' WHEN 6 THEN 'card_parsed_record' END AS constraint_name, key FROM l WHERE v BETWEEN 1 AND 6
  UNION ALL SELECT 'code ' || CASE v WHEN 7 THEN 'parsed' ELSE 'other_code' END, key FROM l WHERE v IN (7, 8)""")
def card_record_violations(spark, sf_dir):
    """Line items as rows of card statements, most with one fault."""
    v, paid = F.col("l_partkey") % 10, F.col("l_returnflag") == "R"
    outcome = F.when(v == 7, "REJECTED").when(v == 8, "IGNORED").otherwise("PARSED")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), outcome.alias("outcome"), F.array(F.when(v == 8, "other_code").otherwise("parsed")).alias("codes"), F.when(v == 3, "unbilled").otherwise("billed_domestic").alias("section"),
        F.when(paid, "payment").otherwise("purchase").alias("section_category"), F.lit(10).alias("billed_amount"), (F.when(paid, -10).otherwise(10) * F.when(v == 5, -1).otherwise(1)).alias("debt_effect"), F.when(v != 4, F.lit("2024-01-01")).alias("transaction_date"), F.when(v == 6, "USD").otherwise("CLP").alias("billed_currency"),
        F.lit("CLP").alias("account_currency"), F.when(v == 1, 5).alias("original_amount"), F.lit(None).cast("string").alias("original_currency"), F.when(v == 2, 0).when(v == 9, 3).alias("installment_number"),
    )
    strange = validation.strange_codes(rows, validation.CARD_VOCABULARY, "key").select(F.concat(F.lit("code "), "code").alias("constraint_name"), "key")
    return constraints.broken(rows, "key", **validation.card_record_rules()).unionByName(strange)


@query("""SELECT CASE o_orderkey % 6 WHEN 1 THEN 'historical_source_account' WHEN 2 THEN 'historical_currency' WHEN 3 THEN 'historical_counts' WHEN 4 THEN 'historical_signed' WHEN 5 THEN 'historical_currency' END AS constraint_name, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 6 > 0""")
def historical_result_violations(spark, sf_dir):
    """Orders as results of historical statements against the accounts they are for."""
    v = F.col("o_orderkey") % 6
    one = lambda n, bad, good: F.when(v == n, bad).otherwise(good)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", one(1, F.lit(None).cast("string"), F.lit("77")).alias("source_account_id"), F.lit("77").alias("expected_source_account_id"), one(2, "USD", "CLP").alias("currency"), one(5, "clp", "CLP").alias("account_currency"),
        F.lit(3).alias("parsed"), F.lit(1).alias("ignored"), F.lit(0).alias("rejected"), one(3, 5, 4).alias("records"), one(4, 1, 0).alias("parsed_unsigned"),
    )
    return constraints.broken(rows, "o_orderkey", **validation.historical_result_rules())


@query("""SELECT l_orderkey, l_linenumber, l_partkey, code FROM (SELECT *, CASE l_partkey % 5 WHEN 0 THEN 'header_row' WHEN 1 THEN 'amount_invalid' WHEN 2 THEN 'running_balance_invalid' WHEN 3 THEN 'unheard_of' ELSE 'date_invalid' END AS code FROM lineitem)
  WHERE NOT CASE l_returnflag WHEN 'A' THEN code = 'running_balance_invalid' WHEN 'N' THEN code = 'header_row' ELSE code IN ('amount_invalid', 'date_invalid') END""")
def code_vocabulary(spark, sf_dir):
    """Line items as rows of sheets: codes that their outcome doesn't have."""
    v = F.col("l_partkey") % 5
    code = F.when(v == 0, "header_row").when(v == 1, "amount_invalid").when(v == 2, "running_balance_invalid").when(v == 3, "unheard_of").otherwise("date_invalid")
    outcome = F.when(F.col("l_returnflag") == "A", "PARSED").when(F.col("l_returnflag") == "N", "IGNORED").otherwise("REJECTED")
    rows = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("key"), outcome.alias("outcome"), F.array(code).alias("codes"))
    return validation.strange_codes(rows, validation.SHEET_VOCABULARY, "key").select("key.*", "code")


def _older(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders and line items in the shape of the older schema."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    raw = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("raw_record_id")
    rows = lines.select(raw, F.col("l_linenumber").alias("row_number"), F.when(F.col("l_returnflag") == "A", "PARSED").otherwise("IGNORED").alias("parse_outcome"), F.when(F.col("l_linestatus") == "O", "E").otherwise("F").alias("c"))
    rows = rows.groupBy("raw_record_id").agg(F.min("row_number").alias("row_number"), F.min("parse_outcome").alias("parse_outcome"), F.min("c").alias("c"))
    return {
        "artifacts": orders.select(F.col("o_orderkey").alias("source_artifact_id"), F.lit("XLSX").alias("source_kind")), "batches": orders.select(F.col("o_orderkey").alias("import_batch_id"), F.col("o_orderkey").alias("source_artifact_id")),
        "records": rows.drop("c"), "movements": rows.filter("parse_outcome = 'PARSED'").select("raw_record_id", F.col("c").alias("amount_source_column")),
    }


@query("""WITH r AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, min(l_linenumber) AS n, min(CASE WHEN l_returnflag = 'A' THEN 'PARSED' ELSE 'IGNORED' END) AS parse_outcome, min(CASE WHEN l_linestatus = 'O' THEN 'E' ELSE 'F' END) AS c FROM lineitem GROUP BY 1)
  SELECT parse_outcome, 'XLSX_ROW' AS record_kind, CASE WHEN parse_outcome = 'PARSED' THEN c END AS xlsx_amount_source_column, count(*) AS n, CAST(sum(n) AS BIGINT) AS ordinals FROM r GROUP BY ALL""")
def schema_backfill(spark, sf_dir):
    """Older records brought forward: kinds, ordinals and the column of each amount."""
    found = backfill.forward(**_older(spark, sf_dir))["records"]
    return found.groupBy("parse_outcome", "record_kind", "xlsx_amount_source_column").agg(F.count("*").alias("n"), F.sum("record_ordinal").cast("long").alias("ordinals"))


@query(f"""WITH m AS ({_MOVEMENTS}), q AS (SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN -o_custkey ELSE o_custkey END AS s, o_orderkey % 2 AS p, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE DATE '1995-01-01' END AS a, CASE WHEN o_orderkey % 13 = 0 THEN DATE '1994-01-01' ELSE DATE '1996-12-31' END AS e FROM orders WHERE o_orderkey % 20 < 7),
  c AS (SELECT q.*, CASE WHEN c_custkey IS NULL OR c_custkey % 3 = p THEN 'account_not_accessible' WHEN a IS NULL OR a > e THEN 'date_range_invalid' END AS code FROM q LEFT JOIN customer ON c_custkey = s)
  SELECT k AS request_id, s AS selector, code, CASE WHEN code IS NULL THEN count(movement_id) END AS movement_count, CASE WHEN code IS NULL THEN CAST(coalesce(sum(signed_amount), 0) AS DECIMAL(38,2)) END AS net_signed_amount
  FROM c LEFT JOIN m ON code IS NULL AND account_id = s AND occurrence_date BETWEEN a AND e GROUP BY k, s, code""")
def authorised_report(spark, sf_dir):
    """Requests of two principals for accounts that they may read, may not, or that aren't there."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda p: F.concat(F.lit("p"), p.cast("string")).alias("principal")
    day = lambda text: F.lit(text).cast("date")
    requests = table(spark, sf_dir, "orders").filter(k % 20 < 7).select(
        k.alias("request_id"), name(k % 2), F.when(k % 9 == 0, -c).otherwise(c).alias("selector"), F.when(k % 11 != 0, day("1995-01-01")).alias("start_date"), F.when(k % 13 == 0, day("1994-01-01")).otherwise(day("1996-12-31")).alias("end_date")
    )
    held = accounts(spark, sf_dir)
    a: Column = F.col("account_id")
    grants = held.select("account_id", F.explode(F.filter(F.array(F.lit(0), F.lit(1)), lambda p: p != a % 3)).alias("p")).select("account_id", name(F.col("p")))
    return report.authorised(requests, grants, held, movements(spark, sf_dir)).select("request_id", "selector", "code", "movement_count", "net_signed_amount")
