"""Import jobs from files to the ledger, as micro-batches.

Files lie below a folder as ``<source kind>/<account>/<name>``: workbooks of current accounts
(XLSX) and tokens of printed historical statements as JSON lines (HISTORICAL_PDF).  A
micro-batch is one job: its files become artifacts (inserted or got, by their bytes), cells
or tokens, classified rows, checked results and decided attempts, and all of that is one
commit of the snapshot log.  A file that fails leaves a FATAL attempt with stage and code
and nothing else; the others of its batch aren't touched.  A batch that is run again finds
its job in the log and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import imports, lifecycle, reconcile, snapshots
from quillon.operators.shared import held
from quillon.sources import cells, historical, layouts, statements, tokens

#: Failure codes of parsers that are told outside; others are called by the stage's own.
PARSER_CODES = (
    "xlsx_invalid", "ambiguous_statement_worksheets", "formula_unsupported", "movement_header_not_found", "period_context_ambiguous", "period_context_invalid", "period_context_missing",
    "native_text_required", "page_number_invalid", "source_identity_mismatch", "statement_identifier_invalid", "account_identity_invalid", "period_missing", "currency_missing", "metadata_ambiguous",
    "period_invalid", "transaction_header_missing", "unsupported_financial_table_geometry", "period_summary_missing", "period_summary_invalid", "period_summary_mismatch", "period_summary_ambiguous",
)
BATCHES = "attempt_id string, job string, digest string, account_id string, source_kind string, filename string, completed_at timestamp, status string, duplicate_of string, failure_stage string, failure_code string, parsed long, ignored long, rejected long, reconciliation_status string, period_start date, period_end date"
ARTIFACTS = "digest string, content binary, filename string"
RECORDS = "attempt_id string, row_number int, outcome string, codes array<string>"
MOVEMENTS = "raw_record_id string, attempt_id string, account_id string, source_kind string, occurrence_date date, description string, signed_amount decimal(20,2)"
_TOKENS = "array<struct<page:int,ordinal:int,text:string,x0:double,y0:double,x1:double,y1:double>>"


def public(code: Column) -> Column:
    """A parser's code as it is told outside: known ones, a package's refusals as ``xlsx_invalid``, others not at all."""
    refused = code.rlike("^(package|sheets?|xml|shared)_")
    return F.when(code.isNull(), None).when(code.isin(*PARSER_CODES), code).when(refused, "xlsx_invalid").otherwise("parser_error_unrecognized")


def read_workbooks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rows) of XLSX files (attempt_id, content); results have attempt_id, stage, code, period and balances."""
    found = held(cells.xlsx_cells(files, key="attempt_id"))
    sheets = layouts.discover_current(found)
    # a workbook without any cell is one without a header
    sheets = files.select(F.col("attempt_id").alias("source_id")).join(sheets, "source_id", "left").withColumn("code", F.when(F.col("code").isNull() & F.col("header_row").isNull(), "movement_header_not_found").otherwise(F.col("code")))
    good = sheets.filter("code IS NULL")
    wide = cells.wide(found, "ABCDEFG").join(good.select("source_id", "sheet_ordinal"), ["source_id", "sheet_ordinal"])
    rows = held(statements.current(wide, good.select("source_id", "period_start", "period_end")))
    beyond = found.filter("code IS NULL AND row_number IS NOT NULL").groupBy("source_id", "sheet_ordinal", "row_number").agg(F.bool_or(F.length("column") * 100 + F.ascii("column") > 171).alias("beyond"))
    shaped = rows.join(beyond, ["source_id", "sheet_ordinal", "row_number"]).join(good.select("source_id", "header_row"), "source_id").filter(F.col("row_number") >= F.col("header_row"))
    faults = imports.sheet_structure(shaped).select("source_id", "fault")
    results = sheets.join(faults, "source_id", "left").select(
        F.col("source_id").alias("attempt_id"), F.when(F.col("code").isNotNull(), "PARSER").when(F.col("fault").isNotNull(), "BOUNDARY").alias("stage"),
        F.coalesce(public(F.col("code")), F.when(F.col("fault").isNotNull(), "boundary_validation_failed")).alias("code"), "period_start", "period_end", "opening_balance", "ending_balance",
    )
    return results, rows.select(F.col("source_id").alias("attempt_id"), "row_number", "outcome", "codes", "date", F.col("C").alias("description"), "signed_amount")


def read_printed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rows) of token files (attempt_id, content)."""
    lines = files.select("attempt_id", F.explode_outer(F.from_json(F.col("content").cast("string"), _TOKENS)).alias("t"))
    found = lines.filter("t.text IS NOT NULL AND t.page IS NOT NULL").select(F.col("attempt_id").alias("doc_id"), "t.*")
    docs, rows = historical.documents(tokens.lines(found))
    classified = held(statements.historical(rows, docs.select("doc_id", "period_start", "period_end")))
    results = files.select("attempt_id").join(docs.withColumnRenamed("doc_id", "attempt_id"), "attempt_id", "left")
    empty = F.col("code").isNull() & F.col("period_start").isNull()
    results = results.select(
        "attempt_id", F.when(F.col("code").isNotNull() | empty, "PARSER").alias("stage"), F.when(empty, "native_text_required").otherwise(public(F.col("code"))).alias("code"), "period_start", "period_end",
        F.col("opening").alias("opening_balance"), F.col("closing").alias("ending_balance"),
    )
    return results, classified.select(F.col("doc_id").alias("attempt_id"), F.col("row").cast("int").alias("row_number"), "outcome", "codes", "date", "description", "signed_amount")


_READERS = {"XLSX": read_workbooks, "HISTORICAL_PDF": read_printed}


def job(files: DataFrame, accounts: DataFrame, ledger: snapshots.Ledger, name: str) -> int | None:
    """Imports files (path, content, source_kind, account_id, filename) as the job ``name``; its snapshot, or null if it is there."""
    if ledger.has(name, ledger.version()):
        return None
    files = held(files.withColumns({"digest": F.sha2("content", 256), "attempt_id": F.sha2(F.concat_ws("\n", F.lit(name), "path"), 256), "completed_at": F.current_timestamp()}))
    parts = [read(files.filter(F.col("source_kind") == kind).select("attempt_id", "content")) for kind, read in _READERS.items()]
    results = held(parts[0][0].unionByName(parts[1][0]))
    rows = held(parts[0][1].unionByName(parts[1][1]))

    def decide(version: int) -> dict[str, DataFrame]:
        artifacts = snapshots.register(files.select("attempt_id", "digest", "content", "filename"), ledger.table("artifacts", version, ARTIFACTS))
        artifacts = held(artifacts)
        clash = artifacts.filter("outcome = 'content_digest_collision'").select("attempt_id", F.lit(True).alias("clash"))
        told = files.drop("content").join(results, "attempt_id", "left").join(clash, "attempt_id", "left")
        told = told.withColumns({"stage": F.when(F.col("clash"), "REGISTRATION").otherwise(F.col("stage")), "failure_code": F.when(F.col("clash"), "content_digest_collision").otherwise(F.col("code"))})
        earlier = ledger.table("batches", version, BATCHES).select("attempt_id", "digest", "account_id", "source_kind", "completed_at", "status")
        decided = imports.decide(told.select("attempt_id", "digest", "account_id", "source_kind", "completed_at", "failure_code"), accounts, rows, earlier=earlier)
        sums = results.filter("code IS NULL").select(F.col("attempt_id").alias("import_batch_id"), "opening_balance", "ending_balance")
        status = reconcile.balance_equation(rows.withColumnRenamed("attempt_id", "import_batch_id"), sums).select(F.col("import_batch_id").alias("attempt_id"), "reconciliation_status")
        decided = decided.join(told.select("attempt_id", "stage", "filename", "period_start", "period_end"), "attempt_id").join(status, "attempt_id", "left")
        stands = F.col("status").isin(*lifecycle.MATERIALIZED)
        fatal = F.col("status") == "FATAL"
        batches = held(decided.select(
            "attempt_id", F.lit(name).alias("job"), "digest", "account_id", "source_kind", "filename", "completed_at", "status", "duplicate_of", F.when(fatal, F.coalesce("stage", F.lit("REGISTRATION"))).alias("failure_stage"), "failure_code",
            *(F.col(c).cast("long").alias(c) for c in ("parsed", "ignored", "rejected")), F.when(stands, F.col("reconciliation_status")).alias("reconciliation_status"), *(F.when(stands, F.col(c)).alias(c) for c in ("period_start", "period_end")),
        ))
        made = imports.ledger(batches, rows)
        names = [c.split()[0] for c in MOVEMENTS.split(", ")]
        fresh = artifacts.filter("outcome = 'NEW'").select("digest", "content", "filename")
        return {"batches": batches, "artifacts": fresh, "raw_records": made["raw_records"], "movements": made["movements"].select(*names), "observations": made["observations"].select(*names, "state")}

    return ledger.commit(name, decide)


def stream(spark: SparkSession, folder: str, limit: int = 100) -> DataFrame:
    """Files below ``folder`` as a stream, with what their path says of them."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", limit).load(folder)
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return files.select("path", "content", part(-3).alias("source_kind"), part(-2).alias("account_id"), part(-1).alias("filename"))


def run(files: DataFrame, accounts: DataFrame, root: str, checkpoint: str, name: str = "imports") -> StreamingQuery:
    """Starts importing what there is; ``name`` tells jobs of several streams apart."""

    def write(batch: DataFrame, number: int) -> None:
        job(batch, accounts, snapshots.Ledger(batch.sparkSession, root), f"{name}-{number}")

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
