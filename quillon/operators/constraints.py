"""Table constraints as views of violations: (constraint_name, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken(rows: DataFrame, key: str, **rules: Column) -> DataFrame:
    """A row for each rule that isn't true of a row (null counts as true, as in CHECK).

    All rules are tested in one pass over the rows.
    """
    names = F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))
    return rows.select(F.explode(names).alias("constraint_name"), F.col(key).cast("string").alias("key"))


def repeated(rows: DataFrame, name: str, *by: str) -> DataFrame:
    found = rows.groupBy(*by).count().filter("count > 1")
    return found.select(F.lit(name).alias("constraint_name"), F.concat_ws("|", *by).alias("key"))


def dangling(rows: DataFrame, name: str, key: str, foreign: str, to: DataFrame, other: str) -> DataFrame:
    """Rows whose foreign key isn't among ``other`` of the table it should lead ``to``."""
    gone = rows.join(to.select(F.col(other).alias("__o")), F.col(foreign) == F.col("__o"), "left_anti")
    return gone.select(F.lit(name).alias("constraint_name"), F.col(key).cast("string").alias("key"))


def every(*views: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, views)


def account_rules() -> dict[str, Column]:
    kind, side = F.col("kind"), F.col("economic_orientation")
    return {"currency_shape": F.col("currency").rlike("^[A-Z]{3}$"), "kind_orientation": ((kind == "CURRENT") & (side == "ASSET")) | ((kind == "CREDIT_CARD") & (side == "LIABILITY"))}


def batch_rules() -> dict[str, Column]:
    s, p, i, r = (F.col(c) for c in ("status", "parsed", "ignored", "rejected"))
    return {
        "status_known": s.isin("PROCESSING", "ACCEPTED", "PARTIAL", "REJECTED", "DUPLICATE", "FATAL"),
        "counts_not_negative": (p >= 0) & (i >= 0) & (r >= 0),
        "counts_match_status": F.when(s == "ACCEPTED", r == 0).when(s == "PARTIAL", (p > 0) & (r > 0)).when(s == "REJECTED", (p == 0) & (r > 0)).when(s.isin("FATAL", "DUPLICATE"), p + i + r == 0),
        "period_order": F.col("period_start") <= F.col("period_end"),
    }
