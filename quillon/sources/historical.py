"""Printed historical statements from tokens: who and when, the table's rows, the printed totals.

Works on lines (``tokens.lines``).  A page's table begins below its header and, on the last
page, ends at the summary.  A line of the table that has an amount and a date or a text
starts a row; lines inside the table go on with it; any other line closes it, and what
follows belongs to no row until another one starts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import money
from quillon.functions.text import quick_recognition_key
from quillon.operators.shared import held
from quillon.sources.tokens import BANDS

#: Words of the table's header with their places, edges of the page's parts, and tolerance.
HEADER = {"fecha": 48, "sucursal": 101, "descripcion": 188, "documento": 287, "cargos": 363, "abonos": 441, "saldo": 507}
HEADER_WORDS = (*HEADER, "diario")
TOLERANCE = 3.0
LEFT, RIGHT, LOWEST_HEADER, TOP = 40, 606, 280, 210
STATEMENT_FROM, ACCOUNT_FROM, ACCOUNT_TO = 530, 440, 510
#: The summary's operands, the words of their labels, the band of their values, and whether they may be negative.
OPERANDS = {"opening": ("saldo anterior", 280, 350, True), "debits": ("total cargos", 350, 426, False), "credits": ("total abonos", 426, 505, False), "closing": ("saldo contable", 535, 605, True)}
PERIOD_FROM, PERIOD_TO, PERIOD_DEPTH, VALUE_DEPTH = 20, 280, 70, 30

_DAY = "(?<![0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9])"
_PAGE, _DOC = ["doc_id", "page"], "doc_id"


def _days(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_DAY), F.lit(0))


def _day(text: Column) -> Column:
    return F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)).try_cast("date")


def _lines(lined: DataFrame) -> DataFrame:
    """A row for each line: its edges, its words for comparison, its tokens from left to right."""
    plain = lined.select(*_PAGE, "line", "ordinal", "text", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), quick_recognition_key("text").alias("label")).repartition(_DOC)  # the one exchange for lines, pages and documents
    tokens = F.array_sort(F.collect_list(F.struct("x0", "ordinal", "x1", "text", "label")))
    rows = plain.groupBy(*_PAGE, "line").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), tokens.alias("t"))
    key = F.array_join(F.filter(F.transform("t", lambda t: t["label"]), lambda x: x != ""), " ")
    rows = rows.withColumn("key", key)
    # the first line above the edge that has all words
    heads = (F.col("y0") <= LOWEST_HEADER) & reduce(Column.__and__, (F.array_contains(F.split("key", " "), w) for w in HEADER_WORDS))
    # whether the header fits goes with each line, not its tokens
    own = F.when(heads, F.struct("line", "y0", "y1", _fits(F.col("t")).alias("fits")))
    rows = rows.withColumn("h", F.min(own).over(Window.partitionBy(*_PAGE)))
    return rows.withColumn("last", F.max("page").over(Window.partitionBy(_DOC)))


def _token(t: Column, low: float, high: float | None = None) -> Column:
    """Texts of whole numbers among tokens that begin between two edges."""
    found = F.filter(t, lambda x: (x["x0"] >= low) & (x["x0"] <= (1e9 if high is None else high)) & x["text"].rlike("^[0-9]+$"))
    return F.transform(found, lambda x: x["text"])


def documents(lined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rows) of lined tokens.

    documents: doc_id, code (null if it can be read), statement_id, source_account_id,
    period_start, period_end and the printed opening, debits, credits and closing (null where
    they aren't found).  rows: those of ``statements.historical``, of documents without a code.
    """
    line = F.struct("page", "line", "y0", "y1", "key", "t")
    found = held(read(_lines(lined).groupBy(_DOC).agg(F.sort_array(F.collect_list(line)).alias("lines"))))  # both results read it
    return found.select(*_RESULT), rows(found).drop("period_start", "period_end")


_RESULT = (_DOC, "code", "statement_id", "source_account_id", "period_start", "period_end", *OPERANDS)


def read(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, ``lines`` as of ``tokens.lines_of``) as ``documents`` returns them, and ``body``:
    the lines of the tables of documents without a code.

    A document stays one row from its tokens on, so nothing is dealt out, sorted or written."""
    words = lambda x: reduce(Column.__and__, (F.array_contains(F.split(x["key"], " "), w) for w in HEADER_WORDS))
    heads = F.filter("lines", lambda x: (x["y0"] <= LOWEST_HEADER) & x["key"].contains(HEADER_WORDS[0]) & words(x))
    # the first line of each page above the edge that has all words
    heads = F.filter(F.transform(heads, lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line"), x["y0"].alias("y0"), x["y1"].alias("y1"), _fits(x["t"]).alias("fits"))), lambda x: x["page"].isNotNull())
    docs = docs.select(_DOC, "lines", heads.alias("heads"), F.array_distinct(F.transform("lines", lambda x: x["page"])).alias("pages"))
    docs = docs.withColumn("heads", F.array_compact(F.transform("pages", lambda p: F.get(F.filter("heads", lambda x: x["page"] == p), F.lit(0)))))
    docs = _summary(_metadata(docs.withColumn("last", F.array_max("pages"))))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    start, end = _day(F.get("period", F.lit(0))), _day(F.get("period", F.lit(1)))
    s_start, s_end = _day(F.get("s_period", F.lit(0))), _day(F.get("s_period", F.lit(1)))
    docs = docs.withColumns({"start": start, "end": end, "s_start": s_start, "s_end": s_end})
    start, end, s_start, s_end = map(F.col, ("start", "end", "s_start", "s_end"))
    code = (
        F.when((F.array_min("pages") != 1) | (F.col("last") != F.size("pages")), "page_number_invalid")
        .when(z("n_product") != 1, "source_identity_mismatch").when(z("n_statement") != 1, "statement_identifier_invalid").when(z("n_account") != 1, "account_identity_invalid")
        .when(z("n_period") != 1, "period_missing").when(z("n_currency") != 1, "currency_missing")
        .when((F.size("statement") != 1) | (F.size("account") != 1), "metadata_ambiguous")
        .when(start.isNull() | end.isNull() | (start > end), "period_invalid")
        .when(F.size("heads") < F.size("pages"), "transaction_header_missing").when(F.exists("heads", lambda h: ~h["fits"]), "unsupported_financial_table_geometry")
        .when((z("n_context") != 1) | (F.coalesce(F.size("s_period"), F.lit(0)) != 2), "period_summary_missing").when(s_start.isNull() | s_end.isNull(), "period_summary_invalid")
        .when((s_start != start) | (s_end != end), "period_summary_mismatch").when(F.col("ambiguous"), "period_summary_ambiguous")
    )
    docs = docs.withColumn("code", code)
    # below the page's header, and above the summary
    head = lambda x: F.get(F.filter("heads", lambda h: h["page"] == x["page"]), F.lit(0))
    below = lambda x: (x["line"] != head(x)["line"]) & (x["y0"] > head(x)["y1"]) & ((x["page"] != F.col("last")) | (x["y0"] < F.col("context_y")))
    body = F.transform(F.filter("lines", below), lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line"), x["t"].alias("t")))
    kept = {"statement_id": F.get("statement", F.lit(0)), "source_account_id": F.get("account", F.lit(0)), "period_start": start, "period_end": end, **{k: F.col(k) for k in OPERANDS}, "body": body}
    return docs.select(_DOC, "code", *(F.when(F.col("code").isNull(), c).alias(k) for k, c in kept.items()))


def _fits(header: Column) -> Column:
    """Whether the first token of each of the header's words stands in its place."""
    at = lambda w: F.get(F.filter(header, lambda t: t["label"] == w), F.lit(0))["x0"]
    return reduce(Column.__and__, (F.coalesce(F.abs(at(w) - x) <= TOLERANCE, F.lit(False)) for w, x in HEADER.items()))


def _metadata(docs: DataFrame) -> DataFrame:
    """Numbers of the lines above the first page's table that name product, statement, account, period and currency, and what they say."""
    table = F.get(F.filter("heads", lambda h: h["page"] == 1), F.lit(0))["y0"]
    docs = docs.withColumn("edge", F.coalesce(table, F.lit(float(TOP))))
    docs = docs.withColumn("top", F.filter("lines", lambda x: (x["page"] == 1) & (x["y0"] < F.col("edge"))))
    has = lambda x, *words: reduce(Column.__and__, (x["key"].contains(w) for w in words))
    statement, account, days = (lambda x: _token(x["t"], STATEMENT_FROM)), (lambda x: _token(x["t"], ACCOUNT_FROM, ACCOUNT_TO)), (lambda x: _days(x["key"]))
    is_ = {
        "product": lambda x: has(x, "bci", "cartola", "cuenta", "corriente"), "statement": lambda x: has(x, "cartola") & (F.size(statement(x)) > 0), "account": lambda x: has(x, "cuenta", "moneda") & (F.size(account(x)) > 0),
        "period": lambda x: has(x, "periodo") & (F.size(days(x)) == 2), "currency": lambda x: has(x, "moneda") & F.exists(x["t"], lambda t: t["label"].isin("pesos", "clp")),
    }
    docs = docs.withColumns({f"of_{k}": F.filter("top", c) for k, c in is_.items()})
    values = {"statement": statement, "account": account, "period": days}
    docs = docs.withColumns({f"n_{k}": F.size(f"of_{k}") for k in is_} | {k: c(F.get(f"of_{k}", F.lit(0))) for k, c in values.items()})
    return docs.drop("top", "edge", *(f"of_{k}" for k in is_))


def _amount(low: float, high: float, negative: bool) -> Callable[[Column], Column]:
    grammar = rf"^{'-?' if negative else ''}([0-9]+|[0-9]{{1,3}}(\.[0-9]{{3}})+)$"
    return lambda t: (t["x0"] >= low) & (t["x0"] < high) & t["text"].rlike(grammar)


def _named(label: str) -> Callable[[Column], Column]:
    return lambda x: reduce(Column.__and__, (F.array_contains(x["words"], w) for w in label.split()))


def _under(one: Column) -> Callable[[Column], Column]:
    return lambda x: (x["y0"] - one["y1"]).between(0, VALUE_DEPTH)


def _summary(docs: DataFrame) -> DataFrame:
    """The last page's summary: its period, and each operand's printed value."""
    context = lambda x: x["key"].contains("resumen") & x["key"].contains("periodo")
    page = docs.withColumns({"every": F.col("lines"), "lines": F.filter("lines", lambda x: x["page"] == F.col("last"))})
    page = page.withColumn("contexts", F.filter("lines", context)).withColumns({"n_context": F.size("contexts"), "context_y": F.array_min(F.transform("contexts", lambda x: x["y0"]))})
    below = F.filter("lines", lambda x: x["y0"] >= F.col("context_y"))
    page = page.withColumn("lines", F.transform(below, lambda x: F.struct(x["y0"].alias("y0"), x["y1"].alias("y1"), F.split(x["key"], " ").alias("words"), x["t"].alias("t"))))
    near = F.flatten(F.transform(F.filter("lines", lambda x: x["y0"] - F.col("context_y") <= PERIOD_DEPTH), lambda x: x["t"]))
    text = F.array_join(F.transform(F.filter(near, lambda t: (t["x0"] >= PERIOD_FROM) & (t["x0"] < PERIOD_TO)), lambda t: t["text"]), " ")
    out = {"s_period": _days(F.regexp_replace(text, r"\s*-\s*", "-"))}
    wrong = []
    for name, (label, low, high, negative) in OPERANDS.items():
        good, labels = _amount(low, high, negative), F.filter("lines", _named(label))
        one = F.get(labels, F.lit(0))
        own = F.filter(one["t"], good)
        around = F.filter(F.flatten(F.transform(F.filter("lines", _under(one)), lambda x: x["t"])), good)
        value = F.when(F.size(own) == 1, F.get(own, F.lit(0))["text"]).when(F.size(around) == 1, F.get(around, F.lit(0))["text"])
        out[name] = F.when(F.size(labels) == 1, money.grouped_amount(value, True))
        wrong.append((F.size(labels) > 1) | ((F.size(labels) == 1) & (F.size(own) != 1) & (F.size(around) > 1)))
    return page.withColumns({**out, "ambiguous": F.coalesce(reduce(Column.__or__, wrong), F.lit(False))}).drop("lines", "contexts").withColumnRenamed("every", "lines")


def rows(docs: DataFrame) -> DataFrame:
    """Rows of the tables of all pages of what ``read`` returns, with the texts of their columns and their document's period."""
    in_band = lambda t, name: (t["x0"] >= BANDS[name][0] - TOLERANCE) & (t["x0"] < BANDS[name][1] + TOLERANCE)
    any_of = lambda x, *names: F.exists(x["t"], lambda t: reduce(Column.__or__, (in_band(t, n) for n in names)))
    inside = lambda x: F.forall(x["t"], lambda t: (t["x0"] >= LEFT - TOLERANCE) & (t["x1"] <= RIGHT + TOLERANCE))
    starts = lambda x: inside(x) & any_of(x, "debit", "credit", "balance") & any_of(x, "date", "branch", "description", "reference")
    body = F.transform("body", lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line"), x["t"].alias("t"), inside(x).alias("inside"), starts(x).alias("starts")))
    found = docs.select(_DOC, "code", "period_start", "period_end", body.alias("body"))
    found = found.withColumn("at", F.array_compact(F.transform("body", lambda x, n: F.when(x["starts"], n + 1))))

    def row(first: Column, n: Column) -> Column:
        """A start opens a row; the next one, a line outside or a new page closes it."""
        x, part = F.element_at("body", first), F.slice("body", first, F.coalesce(F.get("at", n + 1), F.size("body") + 1) - first)
        end = F.array_position(F.transform(part, lambda y: y["inside"] & (y["page"] == x["page"])), False).cast("int")
        part = F.when(end > 0, F.slice(part, 1, F.greatest(end, F.lit(1)) - 1)).otherwise(part)
        return F.struct(x["page"].alias("page"), x["line"].alias("line"), F.flatten(F.transform(part, lambda y: y["t"])).alias("t"))

    # exploding drops what is null; of a mere column, Spark would filter empty lists first, and make them anew for that
    found = found.select(_DOC, "period_start", "period_end", F.posexplode(F.when(F.col("code").isNull(), F.transform("at", row))).alias("n", "x"))
    texts = lambda low, high: F.nullif(F.array_join(F.transform(F.filter("x.t", lambda t: (t["x0"] >= low) & (t["x0"] < high)), lambda t: t["text"]), " "), F.lit(""))
    return found.select(_DOC, "x.page", "x.line", "period_start", "period_end", *(texts(*edges).alias(name) for name, edges in BANDS.items()), (F.col("n") + 1).alias("row"))
