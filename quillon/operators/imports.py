"""Import jobs: which attempts stand, what they leave in the ledger, and writing it as one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.operators import lifecycle, reconcile

#: The account a source may be imported to (kind, orientation, currency or any),
#: and whether its rows become movements or wait as observations.
ROUTES = {
    "XLSX": ("CURRENT", "ASSET", None, True),
    "CARD_PDF": ("CREDIT_CARD", "LIABILITY", None, True),
    "HISTORICAL_PDF": ("CURRENT", "ASSET", "CLP", False),
}


def account_code(source_kind: Column, kind: Column, orientation: Column, currency: Column) -> Column:
    """Why an account can't take a source; null if it can."""
    code = F.when(kind.isNull(), "account_not_found")
    for name, (wanted, side, money, _) in ROUTES.items():
        of = source_kind == name
        bad = ~F.coalesce(currency.rlike("^[A-Z]{3}$"), F.lit(False)) if money is None else ~currency.eqNullSafe(F.lit(money))
        code = code.when(of & (kind != wanted), "account_kind_unsupported").when(of & ~orientation.eqNullSafe(F.lit(side)), "account_orientation_unsupported").when(of & bad, "account_currency_invalid" if money is None else "account_currency_unsupported")
    return code.when(~source_kind.isin(*ROUTES), "source_variant_unsupported")


def decide(attempts: DataFrame, accounts: DataFrame, rows: DataFrame, bindings: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Decides import attempts (attempt_id, digest, account_id, source_kind, completed_at and
    failure_code, the parser's or null; card_last_four if ``bindings`` are given) by their
    classified rows (attempt_id, outcome).

    An account that can't take the source fails first, then an artifact that is there already
    as the same kind is a duplicate and as another one a failure, then the parser's failure and
    a card that isn't the account's.  Status and counts (none for what isn't materialized) follow.
    ``earlier`` are decided attempts (attempt_id, digest, account_id, source_kind,
    completed_at, status) that these come after.
    """
    held = accounts.select("account_id", "kind", "economic_orientation", "currency")
    out = attempts.join(held, "account_id", "left")
    early = account_code(F.col("source_kind"), F.col("kind"), F.col("economic_orientation"), F.col("currency"))
    late = F.col("failure_code")
    if bindings is not None:
        out = out.join(bindings.select("account_id", F.col("card_last_four").alias("__bound")), "account_id", "left")
        card = F.when(F.col("__bound").isNull(), "account_binding_missing").when(~F.col("card_last_four").eqNullSafe(F.col("__bound")), "card_binding_mismatch")
        late = F.coalesce(late, F.when(F.col("source_kind") == "CARD_PDF", card))
    counts = reconcile.batch_status(rows, "attempt_id")
    out = out.withColumns({"__early": early, "__late": late}).join(counts, "attempt_id", "left")
    own = F.when(F.coalesce("__early", "__late").isNotNull(), "FATAL").otherwise(F.coalesce("status", F.lit("ACCEPTED")))
    out = out.withColumn("status", own).drop("failure_code")
    if earlier is not None:
        # the first that stands is all that counts of those before
        before = earlier.filter(F.col("status").isin(*lifecycle.MATERIALIZED)).groupBy("digest", "account_id").agg(F.min_by(F.struct("attempt_id", "source_kind", "status"), F.struct("completed_at", "attempt_id")).alias("b"))
        before = before.join(attempts.select("digest", "account_id").distinct(), ["digest", "account_id"]).select("digest", "account_id", "b.*")
        out = out.withColumn("__before", F.lit(False)).unionByName(before.withColumns({"__before": F.lit(True), "completed_at": F.lit("0001-01-01").cast("timestamp")}), allowMissingColumns=True)
    found = lifecycle.attempts(out)
    if earlier is not None:
        found = found.filter("NOT __before")
    refused = F.col("__early").isNotNull()
    fresh = F.col("duplicate_of").isNull() & F.col("failure_code").isNull()
    status = F.when(refused, "FATAL").otherwise(F.col("decision"))
    code = F.when(refused, F.col("__early")).when(fresh, F.col("__late")).otherwise(F.col("failure_code"))
    stands = status.isin(*lifecycle.MATERIALIZED)
    n = lambda c: F.when(stands, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    return found.select("attempt_id", "account_id", "digest", "source_kind", "completed_at", status.alias("status"), F.when(~refused, F.col("duplicate_of")).alias("duplicate_of"), code.alias("failure_code"), *map(n, ("parsed", "ignored", "rejected")))


def ledger(decided: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """What decided attempts leave: batches, raw records of those that stand, and movements, or
    observations where the route says so, of their parsed rows (attempt_id, row_number, outcome,
    codes, date, description, signed_amount)."""
    stands = decided.filter(F.col("status").isin(*lifecycle.MATERIALIZED)).select("attempt_id", "account_id", "source_kind", "completed_at")
    raw = rows.join(stands, "attempt_id")
    made = [k for k, r in ROUTES.items() if r[3]]
    claims = raw.filter("outcome = 'PARSED'").select(
        F.sha2(F.concat_ws(":", "attempt_id", "row_number"), 256).alias("raw_record_id"), "attempt_id", "account_id", "source_kind", F.col("date").alias("occurrence_date"), "description", "signed_amount"
    )
    return {
        "batches": decided, "raw_records": raw.select("attempt_id", "row_number", "outcome", "codes"),
        "movements": claims.filter(F.col("source_kind").isin(made)), "observations": claims.filter(~F.col("source_kind").isin(made)).withColumn("state", F.lit("UNRESOLVED")),
    }


def ledger_totals(decided: DataFrame, rows: DataFrame) -> DataFrame:
    """How many rows, and of what total (zero for raw records), each attempt leaves in each table
    of ``ledger``.

    Rows are summed up by attempt before they meet the attempts, so that one pass gives all
    tables and no row is joined.
    """
    parsed = F.col("outcome") == "PARSED"
    sums = rows.groupBy("attempt_id").agg(F.count("*").alias("__n"), F.count_if(parsed).alias("__p"), F.sum(F.when(parsed, F.col("signed_amount"))).cast("decimal(38,2)").alias("__s"))
    stands = decided.filter(F.col("status").isin(*lifecycle.MATERIALIZED)).select("attempt_id", F.col("source_kind").isin([k for k, r in ROUTES.items() if r[3]]).alias("__made"))
    line = lambda when, name, n, total: F.when(when, F.struct(name.alias("table_name"), n.alias("n"), total.cast("decimal(38,2)").alias("total")))
    kept = F.when(F.col("__made"), "movements").otherwise("observations")
    lines = F.array(line(F.col("__n") > 0, F.lit("raw_records"), F.col("__n"), F.lit(0)), line((F.col("__p") > 0) & F.col("__made").isNotNull(), kept, F.col("__p"), F.col("__s")))
    return sums.join(stands, "attempt_id").select("attempt_id", F.inline(F.array_compact(lines)))


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def commit(tables: dict[str, DataFrame], root: str, job: str) -> bool:
    """Writes a job's tables as one: each to a folder of the job, and a marker last.

    A job that broke off is written anew over what it left; one that has its marker stays,
    and false is returned.  ``committed`` reads only jobs with a marker.
    """
    spark = next(iter(tables.values())).sparkSession
    marker = f"{root}/_commits/job={job}"
    if _there(spark, f"{marker}/_SUCCESS"):
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/job={job}")
    spark.range(1).select(F.current_timestamp().alias("committed_at")).coalesce(1).write.mode("overwrite").parquet(marker)
    return True


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    done = spark.read.option("basePath", f"{root}/_commits").parquet(f"{root}/_commits/job=*").select(F.col("job").cast("string").alias("job")).distinct()
    return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/job=*").withColumn("job", F.col("job").cast("string")).join(done, "job", "left_semi")


@F.pandas_udf(StringType())
def _hex(values: pd.Series) -> pd.Series:
    return pd.Series([None if x != x else float(x).hex() for x in values], dtype=object)


def raw_cells(cells: DataFrame, by: str, schema: str = "source-row-v1") -> DataFrame:
    """A row's cells (``by``, column, type, value as text, cell_type, number_format, is_date,
    is_formula) as JSON with tagged values, columns in the sheet's order.

    Types are null, boolean, integer, decimal, float (written in hex, so that nothing is
    rounded), datetime, date and string.  A column that isn't one, a NUL, a value that isn't
    of its type or not finite gives the code raw_record_serialization_invalid and no JSON.
    """
    kind, v = F.col("type"), F.col("value")
    number = F.when(kind == "float", v.try_cast("double"))
    cells = cells.withColumn("__hex", _hex(F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)))
    tag = lambda **fields: F.to_json(F.struct(*(x.alias(k) for k, x in fields.items())))
    plain = lambda pattern: F.when(v.rlike(pattern), v)
    texts = {
        "integer": plain("^-?(0|[1-9][0-9]*)$"), "decimal": plain(r"^-?[0-9]+(\.[0-9]+)?$"), "string": F.when(~v.contains("\x00"), v),
        "datetime": F.date_format(v.try_cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "date": F.date_format(v.try_cast("date"), "yyyy-MM-dd"),
    }
    json = F.when(kind == "null", tag(type=kind)).when((kind == "boolean") & v.isin("true", "false"), tag(type=kind, value=v == "true")).when((kind == "float") & F.col("__hex").isNotNull(), tag(type=kind, hex=F.col("__hex")))
    for name, t in texts.items():
        json = json.when((kind == name) & t.isNotNull(), tag(type=kind, text=t))
    good = F.col("column").rlike("^[A-Z]{1,3}$") & json.isNotNull() & ~F.coalesce(F.concat("cell_type", "number_format").contains("\x00"), F.lit(False))
    # the value's JSON is spliced in, since values differ in shape
    rest = F.to_json(F.struct("cell_type", "number_format", "is_date", "is_formula"), {"ignoreNullFields": "false"})
    cell = F.concat(F.lit('{"column":"'), "column", F.lit('","value":'), json, F.lit(","), F.substring(rest, 2, 1 << 30))
    held = F.transform(F.sort_array(F.collect_list(F.struct(F.length("column").alias("n"), "column", cell.alias("json")))), lambda x: x["json"])
    found = cells.groupBy(by).agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("good"), F.array_join(held, ",").alias("cells"))
    whole = F.concat(F.lit(f'{{"schema":"{schema}","cells":['), "cells", F.lit("]}"))
    return found.select(by, F.when(F.col("good"), whole).alias("raw_cells"), F.when(~F.col("good"), "raw_record_serialization_invalid").alias("code"))


def sheet_structure(rows: DataFrame, by: str = "source_id") -> DataFrame:
    """Sheets (``by``, row_number, outcome, codes, beyond: whether a cell lies right of the table)
    that aren't of the known variant, with what is wrong: not just one header, cells beyond the
    table, sections without their end or in the wrong order, rows of another kind inside a
    section, an auxiliary row with movements below."""
    n = F.col("row_number")
    has = lambda c: F.array_contains("codes", c)
    at = lambda f, c: f(F.when(c, n))
    movement = F.col("outcome").isin("PARSED", "REJECTED")
    w = Window.partitionBy(by)
    over = {
        "__header": at(F.min, has("header_row")), "__start": at(F.min, has("commission_summary_section")), "__end": at(F.min, has("post_summary_section")),
        "__last": at(F.max, movement), "__headers": F.count_if(has("header_row")), "__starts": F.count_if(has("commission_summary_section")), "__ends": F.count_if(has("post_summary_section")),
    }
    rows = rows.withColumns({k: c.over(w) for k, c in over.items()})
    start, end = F.col("__start"), F.col("__end")
    wrong = (
        F.when(F.col("__headers") != 1, "header_not_unique").when(F.col("beyond"), "beyond_table")
        .when((F.col("__starts") > 1) | (F.col("__ends") > 1) | (F.col("__starts") != F.col("__ends")) | (start >= end), "sections_unpaired")
        .when(has("commission_summary") & ~F.coalesce((n > start) & (n < end), F.lit(False)), "outside_section").when((n > start) & (n < end) & ~has("commission_summary"), "inside_section")
        .when((n > end) & ~has("auxiliary_row"), "after_section").when((n > F.col("__header")) & has("auxiliary_row") & (n < F.col("__last")), "auxiliary_above_movements")
    )
    return rows.withColumn("__wrong", wrong).filter("__wrong IS NOT NULL").groupBy(by).agg(F.min_by("__wrong", "row_number").alias("fault"), F.count("*").alias("rows"))
