import datetime
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillon.functions import dates, ids, money, text

D = datetime.date


def values(spark, items, f, kind="string"):
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(items)], f"k int, x {kind}")
    return [r["v"] for r in frame.select("k", f(F.col("x")).alias("v")).orderBy("k").collect()]


def test_labels(spark):
    items = ["  Débito  N° 1 ", "ﬁn\u00a0ÑANDÚ", "", None]
    assert values(spark, items, text.label_key) == ["debiton1", "finnandu", "", None]
    assert values(spark, items, text.collapsed_label) == ["debito n° 1", "fin nandu", "", None]
    assert values(spark, ["Descripción  X", None], text.recognition_key) == ["descripcion x", None]
    assert values(spark, [" e\u0301 ", "a\x07b", None], text.clean_text) == ["é", None, None]
    assert values(spark, ["Débito 1", None], text.ascii_label_key) == ["debito1", None]
    assert values(spark, ["a.B:c-1", ".a", "", None, "x" * 65], text.is_identifier) == [True, False, False, False, False]
    assert values(spark, ["/tmp/a b.pdf", "c:\\x\\y.xls", "dir/", None], text.base_name) == ["a b.pdf", "y.xls", None, None]
    assert values(spark, ["  \u00a0", " a ", None], text.blank_to_null) == [None, "a", None]
    assert values(spark, ["card XXXX-XXXX-1234", "**** 1234 and ****5678", "1234", None], text.card_suffix) == ["1234", None, None, None]


@pytest.mark.parametrize(
    ("raw", "value", "code"),
    [
        ("1.234,56", "1234.56", None), ("1,234.5", "1234.5", None), ("$ 1.234.567", "1234567", None), ("1234.567", "1234567", None), ("12,3", "12.3", None), ("1.23.456", None, "amount_invalid"),
        ("-5", None, "negative_source_amount"), ("$-5", None, "negative_source_amount"), ("(5)", None, "negative_source_amount"), ("0", "0", "zero_amount_unsupported"), ("", None, "amount_missing"), (None, None, "amount_missing"), ("abc", None, "amount_invalid"), ("1,2345", None, "amount_invalid"), ("9" * 19, None, "amount_invalid"),
    ],
)
def test_sheet_amounts(spark, raw, value, code):
    r = values(spark, [raw], money.sheet_amount)[0]
    assert (r["value"], r["code"]) == (Decimal(value) if value else None, code)


def test_sheet_cells(spark):
    rows = [(0, "0.125", "n"), (1, "12.5", "n"), (2, "-1", "n"), (3, "1.234", "text"), (4, "1", "b"), (5, "0", "n"), (6, "1E3", "n"), (7, "2026-01-01", "date"), (8, None, "n")]
    frame = spark.createDataFrame(rows, "k int, x string, t string")
    found = [(r["v"]["value"], r["v"]["code"]) for r in frame.select("k", money.sheet_cell(F.col("x"), F.col("t")).alias("v")).orderBy("k").collect()]
    assert found == [(None, "money_scale_exceeded"), (Decimal("12.5"), None), (None, "negative_source_amount"), (Decimal(1234), None), (None, "amount_invalid"), (None, "zero_amount_unsupported"), (Decimal(1000), None), (None, "amount_invalid"), (None, "amount_invalid")]


def test_other_money(spark):
    assert values(spark, ["1.234,5", "1,5", "1.234", "(1.234)", "x", None], money.token_amount) == ["1234.5", "1.5", "1.234", "-1.234", None, None]
    assert values(spark, ["1.234", "-1.234"], lambda c: money.token_amount(c, F.lit(True))) == ["1234", "-1234"]
    assert values(spark, ["1.234", "12", "1.23", "-1", None], money.grouped_amount) == [Decimal(1234), Decimal(12), None, None, None]
    assert values(spark, ["-1.234"], lambda c: money.grouped_amount(c, True)) == [Decimal(-1234)]
    assert values(spark, ["1.005", "1.00", "0.00", "nan", "1" * 19, None], money.movement_code) == ["money_scale_exceeded", None, "movement_amount_zero", "money_not_finite", "money_precision_exceeded", "money_not_finite"]
    assert values(spark, [Decimal("1234567.00"), Decimal("-5.50"), Decimal(0)], money.shown, "decimal(20,2)") == ["+1.234.567", "−5,50", "0"]


def test_dates(spark):
    assert values(spark, ["2026-01-05", "5/1/2026", "31/02/2026", "5.1.2026", "5/1-2026", "x", None], dates.full_date) == [D(2026, 1, 5), D(2026, 1, 5), None, None, None, None, None]
    assert values(spark, ["05-01-2026", "5-1-2026", "05/01/2026"], lambda c: dates.exact_date(c, "-")) == [D(2026, 1, 5), None, None]
    found = values(spark, ["el 3 de Marzo de 2026 y 04/05/2026, 3 marzo 2026", "nada"], dates.month_dates)
    assert found == [[D(2026, 5, 4), D(2026, 3, 3)], []]
    day = lambda s: F.lit(s).cast("date")
    inside = values(spark, ["31/12", "02/01", "15/06", "29/02", "30/02", "x", None], lambda c: dates.resolved(c, day("2025-12-20"), day("2026-01-20")))
    assert [(r["value"], r["code"]) for r in inside] == [(D(2025, 12, 31), None), (D(2026, 1, 2), None), (None, "date_year_ambiguous"), (None, "date_year_ambiguous"), (None, "date_invalid"), (None, "date_invalid"), (None, "date_invalid")]
    assert values(spark, ["10/01"], lambda c: dates.resolved(c, day("2025-01-01"), day("2026-02-01")))[0]["code"] == "date_year_ambiguous"


def test_ids(spark):
    ns = uuid.NAMESPACE_URL
    assert values(spark, ["a", "é", ""], lambda c: ids.uuid5(str(ns), c)) == [str(uuid.uuid5(ns, x)) for x in ("a", "é", "")]
    assert values(spark, ["A", "Z", "aa", "ZZ", "1", None], ids.column_number) == [1, 26, 27, 702, None, None]
    assert values(spark, [1, 26, 27, 702, 703], ids.column_letter, "int") == ["A", "Z", "AA", "ZZ", None]
    assert values(spark, [1.0, 612.0], lambda c: ids.share(c, F.lit(612.0)), "double") == [Decimal("0.001634"), Decimal(1)]


def test_grouped_amounts_are_read_with_one_pattern(spark, sf_dir):
    from quillon.plans.catalogue import historical_rows

    texts = ["9" * 18, "9" * 19, "-" + "9" * 19, "0" * 40 + "7", "-0", "1.234.567", "1.23", "", "-", "1\n", None]
    nines = Decimal("9" * 18)
    assert values(spark, texts, lambda c: money.grouped_amount(c, True)) == [nines, None, None, Decimal(7), Decimal(0), Decimal(1234567), None, None, None, values(spark, ["1\n"], lambda c: c.try_cast(money.MONEY))[0], None]
    assert values(spark, texts, lambda c: money.grouped_code(c, True))[:9] == [None, "overflow", "overflow", None, None, None, "invalid", "invalid", "invalid"]
    assert values(spark, ["05-01-2026", "31-02-2026", "5-01-2026 ", "é5-01-2026"], lambda c: dates.exact_date(c, "-")) == [D(2026, 1, 5), None, None, None]
    plan = historical_rows(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 10 and "regexp_extract" not in plan
