"""Backfills of an older schema, forward and back, that refuse what they don't know.

Whether the parsed rows and the rows of movements are the same is told by counts an id, in
the pass that tests all else.  Sets of any kind are compared by digests that don't depend on
order (how many, sum and exclusive-or of hashes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XLSX, ROW = "XLSX", "XLSX_ROW"
ORIENTATION = {"CURRENT": "ASSET", "CREDIT_CARD": "LIABILITY"}


class Refused(ValueError):
    """A backfill that would have to guess; the argument is a stable code."""


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: n, total and mix of the rows' hashes.  Equal for equal multisets, in any order."""
    h = [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]
    return rows.agg(F.count("*").alias("n"), *(F.sum(x.cast("decimal(20,0)")).cast("string").alias(f"total{k}") for k, x in enumerate(h)), F.bit_xor(h[0]).alias("mix"))


def same(a: DataFrame, b: DataFrame, *columns: str) -> bool:
    return digest(a, *columns).first() == digest(b, *columns).first()


def _refuse(rows: DataFrame, *rules: tuple[str, Column]) -> None:
    """Raises the first code, in order of the rules, that a row breaks."""
    n = rows.agg(*(F.count_if(F.coalesce(test, F.lit(True))).alias(code) for code, test in rules)).first()
    for code, _ in rules:
        if n[code]:
            raise Refused(code)


def orientations(accounts: DataFrame) -> DataFrame:
    """Accounts with the side that their kind has."""
    _refuse(accounts, ("account_kind_unknown", ~F.col("kind").isin(*ORIENTATION)))
    return accounts.withColumn("economic_orientation", F.create_map(*(F.lit(x) for kv in ORIENTATION.items() for x in kv))[F.col("kind")])


def forward(artifacts: DataFrame, batches: DataFrame, records: DataFrame, movements: DataFrame) -> dict[str, DataFrame]:
    """The kind goes from artifacts (source_kind) to batches; records (row_number,
    parse_outcome) get kind and ordinal, and their movement's amount_source_column."""
    _refuse(artifacts, ("source_kind_unknown", F.col("source_kind") != XLSX))
    # both tables meet by id once: a row an id tells what each side has of it
    marked = records.select("raw_record_id", F.lit(False).alias("moves"), (F.col("row_number") <= 0).alias("bad"), (F.col("parse_outcome") == "PARSED").alias("parsed"))
    moved = movements.select("raw_record_id", F.lit(True).alias("moves"), (~F.col("amount_source_column").isin("E", "F")).alias("bad"), F.lit(None).cast("boolean").alias("parsed"))
    parsed = F.coalesce("parsed", F.lit(False))
    bad = lambda moves: F.count_if((F.col("moves") == moves) & F.coalesce("bad", F.lit(True)))
    ids = marked.unionByName(moved).groupBy("raw_record_id").agg(
        bad(False).alias("rows"), bad(True).alias("columns"), F.count_if("moves").alias("movements"), F.count_if(~F.col("moves") & parsed).alias("parsed"), F.count_if(~F.col("moves") & ~parsed).alias("unparsed"),
    )
    alone = F.col("raw_record_id").isNull() | (F.col("unparsed") > 0) | (F.col("parsed") == 0)
    _refuse(
        ids, ("row_number_invalid", F.col("rows") > 0), ("amount_column_unknown", F.col("columns") > 0), ("movement_of_unparsed", (F.col("movements") > 0) & alone), ("parsed_rows_and_movements_differ", F.col("parsed") != F.col("movements")),
    )
    column = movements.select("raw_record_id", F.col("amount_source_column").alias("xlsx_amount_source_column"))
    new = records.join(column, "raw_record_id", "left").withColumns({"record_kind": F.lit(ROW), "record_ordinal": F.col("row_number")})
    return {"artifacts": artifacts.drop("source_kind"), "batches": batches.withColumn("source_kind", F.lit(XLSX)), "records": new.drop("row_number"), "movements": movements.drop("amount_source_column")}


def back(artifacts: DataFrame, batches: DataFrame, records: DataFrame, movements: DataFrame) -> dict[str, DataFrame]:
    """Undoes ``forward``; refuses what the older schema can't hold."""
    _refuse(batches, ("source_kind_unknown", F.col("source_kind") != XLSX))
    _refuse(records, ("record_kind_unknown", F.col("record_kind") != ROW), ("row_number_invalid", F.col("record_ordinal") <= 0))
    if artifacts.join(batches, artifacts["source_artifact_id"] == batches["source_artifact_id"], "left_anti").limit(1).count():
        raise Refused("artifact_without_batch")
    column = records.select("raw_record_id", F.col("xlsx_amount_source_column").alias("amount_source_column"))
    old = movements.join(column, "raw_record_id", "left")
    _refuse(old, ("amount_column_unknown", ~F.col("amount_source_column").isin("E", "F")))
    return {
        "artifacts": artifacts.withColumn("source_kind", F.lit(XLSX)), "batches": batches.drop("source_kind"),
        "records": records.withColumn("row_number", F.col("record_ordinal")).drop("record_kind", "record_ordinal", "xlsx_amount_source_column"), "movements": old,
    }
