"""Validation of results as views of violations: (constraint_name, key), empty if all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import clean_text
from quillon.operators.imports import ROUTES

#: States, actions and outcomes, as the tables name them.
STATES = ("UNRESOLVED", "RESOLVED", "REJECTED", "CONFLICT", "SUPERSEDED")
OUTCOMES = ("PARSED", "IGNORED", "REJECTED")


def result_graph(rows: DataFrame, summary: DataFrame, by: str = "import_batch_id") -> DataFrame:
    """A parser's rows (row_number, outcome, codes, signed_amount) against its summary (parsed,
    ignored, rejected): numbers run from 1 without gaps, outcomes have the codes and amounts
    that they need, and counts agree."""
    outcome, number = F.col("outcome"), F.col("row_number")
    ordered = Window.partitionBy(by).orderBy("row_number")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = lambda test: F.count_if(test).over(so_far)
    # a batch's rows in turn, its last one has the sums: equal numbers follow each other, and no table of (batch, number) is held
    found = rows.withColumn("__new", F.when(~number.eqNullSafe(F.lag(number).over(ordered)), number)).select(
        by, F.count("*").over(so_far).alias("rows"), F.count("__new").over(so_far).alias("numbers"), F.min("row_number").over(so_far).alias("low"), F.max("row_number").over(so_far).alias("high"),
        *(n(outcome == o).alias(f"n_{o.lower()}") for o in OUTCOMES), n(~F.coalesce(outcome.isin(*OUTCOMES), F.lit(False))).alias("unknown"),
        n((outcome != "PARSED") & (F.coalesce(F.size("codes"), F.lit(0)) == 0)).alias("uncoded"),
        n((outcome == "PARSED") != F.col("signed_amount").isNotNull()).alias("amounts"), n(F.col("signed_amount") == 0).alias("zeros"),
        F.lead(F.lit(False), 1, True).over(ordered).alias("__last"),
    ).filter("__last").drop("__last")
    found = summary.join(found, by, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    wrong: dict[str, Column] = {
        "row_numbers_contiguous": (z("rows") > 0) & ((F.col("low") != 1) | (F.col("high") != F.col("rows")) | (F.col("numbers") != F.col("rows"))),
        "outcome_known": z("unknown") > 0, "codes_match_outcome": z("uncoded") > 0, "amount_matches_outcome": z("amounts") > 0, "amount_not_zero": z("zeros") > 0,
        "counts_match": (z("n_parsed") != F.col("parsed")) | (z("n_ignored") != F.col("ignored")) | (z("n_rejected") != F.col("rejected")),
    }
    names = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in wrong.items())))
    return found.select(F.explode(names).alias("constraint_name"), F.col(by).cast("string").alias("key"))


def movement_counts(counts: DataFrame, movements: DataFrame, by: str = "import_batch_id") -> DataFrame:
    """Batches whose number of parsed rows isn't that of their movements."""
    made = movements.groupBy(by).agg(F.count("*").alias("__n"))
    rows = counts.select(by, "parsed").join(made, by, "full_outer")
    return rows.filter(F.coalesce("parsed", F.lit(0)) != F.coalesce("__n", F.lit(0))).select(by, F.coalesce("parsed", F.lit(0)).alias("parsed"), F.coalesce("__n", F.lit(0)).alias("movements"))


def report_contract(report: DataFrame, envelope: DataFrame) -> DataFrame:
    """Reports (account_id, movement_id, signed_amount as text, occurrence_date as text) against
    their envelopes (account_id, movement_count, net_signed_amount)."""
    money, day = F.coalesce(F.col("signed_amount").rlike(r"^-?[0-9]+\.[0-9]{2}$"), F.lit(False)), F.coalesce(F.col("occurrence_date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))
    found = report.groupBy("account_id").agg(F.count("*").alias("n"), F.count_if(~money | ~day).alias("malformed"), F.sum(F.when(money, F.col("signed_amount").try_cast("decimal(20,2)"))).alias("total"), F.count_distinct("movement_id").alias("ids"))
    rows = envelope.join(found, "account_id", "left")
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0).cast("decimal(30,2)"))
    wrong = {"count_matches": n != F.col("movement_count"), "total_matches": total != F.col("net_signed_amount"), "values_well_formed": F.coalesce("malformed", F.lit(0)) > 0, "ids_unique": F.coalesce("ids", F.lit(0)) != n}
    names = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in wrong.items())))
    return rows.select(F.explode(names).alias("constraint_name"), F.col("account_id").cast("string").alias("key"))


def observation_rules() -> dict[str, Column]:
    state, movement = F.col("state"), F.col("current_movement_id")
    return {
        "observation_state_known": state.isin(*STATES),
        "observation_not_zero": F.col("signed_amount") != 0,
        "observation_dated": F.col("transaction_date").isNotNull() | F.col("accounting_date").isNotNull(),
        "observation_movement_by_state": F.when(state.isin("RESOLVED", "CONFLICT"), movement.isNotNull()).otherwise(movement.isNull()),
        "observation_currency": F.col("currency").rlike("^[A-Z]{3}$"),
    }


def resolution_rules() -> dict[str, Column]:
    action, before, movement, successor = (F.col(c) for c in ("action", "from_state", "movement_id", "successor_id"))
    shape = (
        F.when(action.isin("CONFIRM_NEW", "MATCH_EXISTING", "MARK_CONFLICT"), movement.isNotNull() & successor.isNull())
        .when(action == "REJECT", movement.isNull() & successor.isNull())
        .when(action == "REOPEN", successor.isNull() & (movement.isNotNull() == (before == "CONFLICT")))
        .when(action == "SUPERSEDE", successor.isNotNull() & (movement.isNotNull() == before.isin("RESOLVED", "CONFLICT")))
    )
    return {"resolution_sequence": F.col("sequence") > 0, "resolution_shape": F.coalesce(shape, F.lit(False)), "resolution_successor_other": successor != F.col("observation_id")}


#: Codes of sheet rows and of card rows by outcome; what is known and in neither of the two is rejected.
ROW_CODES = frozenset(
    """amount_invalid amount_missing auxiliary_row blank_row commission_summary commission_summary_section date_invalid date_outside_period date_unsupported date_year_ambiguous debit_credit_conflict
    formula_unsupported header_row metadata_row money_precision_exceeded money_scale_exceeded negative_source_amount post_summary_section repeated_header running_balance_invalid zero_amount_unsupported""".split()
)
CARD_CODES = frozenset(
    """parsed unbilled_future date_invalid amount_ambiguous amount_malformed money_scale_exceeded zero_amount_unsupported original_currency_unsupported original_currency_ambiguous original_amount_missing
    original_amount_ambiguous original_amount_malformed unsupported_row_geometry incompatible_monetary_columns currency_ambiguous category_ambiguous""".split()
)


def vocabulary(known: frozenset[str], parsed: frozenset[str], ignored: frozenset[str]) -> dict[str, frozenset[str]]:
    """Codes by outcome; the parts must be known and apart."""
    if not parsed | ignored <= known or parsed & ignored:
        raise ValueError("vocabulary_inconsistent")
    return {"PARSED": parsed, "IGNORED": ignored, "REJECTED": known - parsed - ignored}


SHEET_VOCABULARY = vocabulary(ROW_CODES, frozenset({"running_balance_invalid"}), frozenset(c for c in ROW_CODES if c.endswith(("_row", "_section", "_header", "_summary"))))
CARD_VOCABULARY = vocabulary(CARD_CODES, frozenset({"parsed"}), frozenset({"unbilled_future"}))


def strange_codes(rows: DataFrame, words: dict[str, frozenset[str]], key: str, codes: str = "codes") -> DataFrame:
    """``key`` and code of each code that a row's outcome doesn't have."""
    allowed = F.create_map(*(x for k, v in words.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))))
    none = F.array().cast("array<string>")
    return rows.select(key, F.explode(F.array_except(codes, F.coalesce(allowed[F.col("outcome")], none))).alias("code"))


#: Operands of a card statement's equation and their signs.
CARD_OPERANDS = {"previous_balance": 1, "purchases_charges": 1, "financial_charges": 1, "payments_credits": -1, "current_billed_balance": -1}


def card_result_rules() -> dict[str, Column]:
    """Of statements (status, difference, missing: names, and the operands' columns): what a
    reconciliation may look like, its equation computed anew."""
    s, d, missing = F.col("reconciliation_status"), F.col("difference"), F.col("missing")
    absent = F.array_compact(F.array(*(F.when(F.col(n).isNull(), n) for n in CARD_OPERANDS)))
    whole = (F.size(absent) == 0) & (F.size(missing) == 0) & d.isNotNull()
    expected = sum((F.col(n) * sign for n, sign in CARD_OPERANDS.items()), F.lit(0))
    settled = s.isin("RECONCILED", "NOT_RECONCILED")
    return {
        "card_status_known": s.isin("RECONCILED", "NOT_RECONCILED", "INSUFFICIENT_DATA", "NOT_APPLICABLE"),
        "card_missing_known": (F.size(F.array_except(missing, F.array(*map(F.lit, CARD_OPERANDS)))) == 0) & (F.size(F.array_distinct(missing)) == F.size(missing)),
        "card_equation": F.when(settled, whole & F.coalesce((d == expected) & ((s == "RECONCILED") == (expected == 0)), F.lit(False))),
        "card_insufficient": F.when(s == "INSUFFICIENT_DATA", d.isNull() & (F.array_sort(missing) == F.array_sort(absent))),
        "card_not_applicable": F.when(s == "NOT_APPLICABLE", d.isNull()),
        "card_rejected_row": F.when(F.col("billed_rejected") > 0, s == "INSUFFICIENT_DATA"),
        "card_period": F.coalesce(F.col("period_start") <= F.col("period_end"), F.lit(False)) & F.col("cutoff_date").isNotNull() & F.col("due_date").isNotNull(),
        "card_suffix": F.coalesce(F.col("card_last_four").rlike("^[0-9]{4}$"), F.lit(False)),
        "card_currency": F.col("statement_currency") == F.col("account_currency"),
    }


def card_record_rules() -> dict[str, Column]:
    """Of a card statement's rows, beside their codes (``strange_codes``)."""
    parsed, paid = F.col("outcome") == "PARSED", F.col("section_category").isin("payment", "credit_refund")
    amount, effect = F.col("billed_amount"), F.col("debt_effect")
    have = F.col("transaction_date").isNotNull() & (F.col("billed_currency") == F.col("account_currency")) & (amount > 0) & F.col("section_category").isNotNull() & (effect != 0)
    return {
        "card_original_pair": F.col("original_amount").isNull() == F.col("original_currency").isNull(),
        "card_installment": F.col("installment_number") > 0,
        "card_unbilled_parsed": ~(parsed & (F.col("section") == "unbilled")),
        "card_parsed_record": F.when(parsed, F.coalesce(have, F.lit(False))),
        "card_debt_effect": F.when(parsed, effect == F.when(paid, -amount).otherwise(amount)),
    }


def historical_result_rules() -> dict[str, Column]:
    """Of historical statements (counts and source_account_id) against the account they were imported for."""
    return {
        "historical_source_account": F.coalesce(F.col("source_account_id") == F.col("expected_source_account_id"), F.lit(False)),
        "historical_currency": F.coalesce((F.col("currency") == F.col("account_currency")) & (F.col("account_currency") == "CLP"), F.lit(False)),
        "historical_counts": F.col("parsed") + F.col("ignored") + F.col("rejected") == F.col("records"),
        "historical_signed": F.col("parsed_unsigned") == 0,
    }


def artifact_rules() -> dict[str, Column]:
    return {"artifact_digest_shape": F.col("digest").rlike("^[0-9a-f]{64}$")}


def movement_rules() -> dict[str, Column]:
    return {"movement_not_zero": F.col("signed_amount") != 0, "movement_currency": F.col("currency").rlike("^[A-Z]{3}$"), "movement_of_parsed": F.col("parse_outcome") == "PARSED"}


def category_rules() -> dict[str, Column]:
    """A name is there, trimmed, of 1 to 80 characters, without control characters and in composed form."""
    name = F.col("display_name")
    good = name.rlike(r"^\S(.{0,78}\S)?$") & ~name.rlike(r"\p{Cc}") & name.eqNullSafe(clean_text(name))
    return {"category_name": F.coalesce(good, F.lit(False))}


def category_repeats(categories: DataFrame, key: str = "category_id") -> DataFrame:
    """Categories whose name differs from another's by case alone, or not at all."""
    folded = categories.filter("display_name IS NOT NULL").select(F.col(key).alias("__key"), F.expr("display_name COLLATE UTF8_LCASE").alias("name"))
    n = F.count("*").over(Window.partitionBy("name"))
    return folded.withColumn("n", n).filter("n > 1").select(F.lit("category_name_unique").alias("constraint_name"), F.col("__key").cast("string").alias("key"))


def classification_rules() -> dict[str, Column]:
    return {"classification_manual": F.col("source") == "MANUAL", "classification_revision": F.col("revision") >= 1}


def attempt_rules() -> dict[str, Column]:
    s = F.col("status")
    fails = F.col("failure_code").isNotNull()
    return {
        "attempt_failure_by_status": fails == (s == "FATAL"),
        "attempt_duplicate_by_status": F.col("duplicate_of").isNotNull() == (s == "DUPLICATE"),
        "attempt_completed": (s == "PROCESSING") == F.col("completed_at").isNull(),
        "attempt_duplicate_not_self": F.col("duplicate_of") != F.col("attempt_id"),
        "attempt_kind_known": F.col("source_kind").isin(*ROUTES),
    }
