"""Movement reports: provenance, three-state classification, totals, discovery."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_range(start: datetime.date, end: datetime.date) -> None:
    for name, value in (("start", start), ("end", end)):
        if not isinstance(value, datetime.date) or isinstance(value, datetime.datetime):
            raise ValueError(f"{name}_date_invalid")
    if start > end:
        raise ValueError("date_range_invalid")


def classified(movements: DataFrame, classifications: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds state, category_id, category_name, category_active and revision to movements.

    No row: NEVER_ASSIGNED at revision 0; a null category: CLEARED; else CLASSIFIED, also
    where the category is retired.  Both joins are outer and on keys, so rows neither
    multiply nor go.
    """
    c = classifications.select(F.col("movement_id").alias("__m"), F.col("category_id").alias("__c"), F.col("revision").alias("__r"))
    k = categories.select(F.col("category_id").alias("__k"), F.col("display_name").alias("category_name"), F.col("is_active").alias("category_active"))
    out = movements.join(c, movements["movement_id"] == c["__m"], "left").join(k, F.col("__c") == F.col("__k"), "left")
    state = F.when(F.col("__m").isNull(), "NEVER_ASSIGNED").when(F.col("__c").isNull(), "CLEARED").otherwise("CLASSIFIED")
    return out.select(*movements.columns, state.alias("state"), F.col("__c").alias("category_id"), "category_name", "category_active", F.coalesce("__r", F.lit(0)).cast("long").alias("revision"))


def traced(movements: DataFrame, records: DataFrame, batches: DataFrame) -> DataFrame:
    """Adds where movements come from; the artifact's key is on the batch."""
    return movements.join(records.select("raw_record_id", "import_batch_id"), "raw_record_id").join(batches.select("import_batch_id", "source_artifact_id", "source_kind", "import_status", "reconciliation_status"), "import_batch_id")


def movements_between(movements: DataFrame, account_id, start: datetime.date, end: datetime.date) -> DataFrame:
    """One account's movements of an inclusive range, in report order."""
    check_range(start, end)
    return movements.filter((F.col("account_id") == account_id) & F.col("occurrence_date").between(F.lit(start), F.lit(end))).orderBy("occurrence_date", "movement_id")


def totals(movements: DataFrame, *by: str) -> DataFrame:
    """movement_count and net_signed_amount; 0 and 0.00 for an empty whole."""
    net = F.coalesce(F.sum("signed_amount").cast("decimal(38,2)"), F.lit(0).cast("decimal(38,2)"))
    return movements.groupBy(*by).agg(F.count("*").alias("movement_count"), net.alias("net_signed_amount"))


def account_totals(accounts: DataFrame, movements: DataFrame) -> DataFrame:
    """Totals of all accounts, also of those without a movement."""
    found = totals(movements, "account_id")
    out = accounts.select("account_id").join(found, "account_id", "left")
    return out.select("account_id", F.coalesce("movement_count", F.lit(0)).alias("movement_count"), F.coalesce("net_signed_amount", F.lit(0).cast("decimal(38,2)")).alias("net_signed_amount"))


def discover(accounts: DataFrame) -> DataFrame:
    return accounts.orderBy("display_name", "account_id")


def as_json(report: DataFrame) -> DataFrame:
    """One JSON text a row; decimals are texts, so that no reader rounds them."""
    columns = [F.col(n).cast("string").alias(n) if t.startswith("decimal") or t == "date" else F.col(n) for n, t in report.dtypes]
    return report.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def authorised(requests: DataFrame, grants: DataFrame, accounts: DataFrame, movements: DataFrame) -> DataFrame:
    """Answers requests (request_id, principal, selector, start_date, end_date) for an account's report.

    A selector that names no account and one that the principal has no grant (principal,
    account_id) for look alike: account_not_accessible.  Dates are tested only for those
    that may read.  Adds code, movement_count and net_signed_amount (null with a code).
    Selectors narrow the movements before they are read, as Spark prunes by the join.
    """
    readable = grants.join(accounts.select("account_id"), "account_id").select("principal", F.col("account_id").alias("selector"), F.lit(True).alias("__may")).distinct()
    asked = requests.join(readable, ["principal", "selector"], "left")
    dated = F.col("start_date").isNotNull() & F.col("end_date").isNotNull() & (F.col("start_date") <= F.col("end_date"))
    asked = asked.withColumn("code", F.when(F.col("__may").isNull(), "account_not_accessible").when(~dated, "date_range_invalid"))
    good = asked.filter("code IS NULL").select("request_id", F.col("selector").alias("account_id"), "start_date", "end_date")
    found = movements.join(good, "account_id").filter(F.col("occurrence_date").between(F.col("start_date"), F.col("end_date")))
    sums = totals(found, "request_id")
    out = asked.join(sums, "request_id", "left")
    fine = F.col("code").isNull()
    zero = F.lit(0).cast("decimal(38,2)")
    return out.select(*requests.columns, "code", F.when(fine, F.coalesce("movement_count", F.lit(0))).alias("movement_count"), F.when(fine, F.coalesce("net_signed_amount", zero)).alias("net_signed_amount"))
