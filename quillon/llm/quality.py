"""Quality rules learned from labels: decision lists as Spark conditional expressions.

Statistics of a text are DataFrame expressions.  From those of labelled texts sequential
covering learns an ordered list of rules for poor texts: a rule grows by the threshold that
gains most (on two thirds of the rows), is pruned on the rest, and what it covers is
removed.  The list is emitted as one ``CASE WHEN``.

* a null text has no words and fails the base test, like an empty one
* a null label, or contradictory labels of a document, aren't learned from; without both
  kinds of label the list is empty and keeps all
* texts of any length are read whole, without leaving the row
* repeated rows stay; an empty table gives an empty result
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that are sampled to learn from.
FIT_DOCS = 8000
FEATURES = ("n_words", "word_length", "symbols", "upper", "dup_lines", "repeats")
#: A rule must be right on so many of the poor texts it covers that were held back.
PRECISION, SUPPORT = 0.9, 5
WINDOW = 5

Rule = list[tuple[str, str, float]]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeats(words: Column) -> Column:
    """How many words stand in a window of five that the text has twice or more."""
    shifted = F.arrays_zip(words, *(F.slice(words, F.lit(1 + k), F.size(words)) for k in range(1, WINDOW)))
    windows = F.slice(shifted, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    is_ = lambda s, x, k: F.coalesce(F.get(s, k)["v"] == x["v"], F.lit(False))
    placed = lambda v: F.array_sort(F.transform(v, lambda x, k: F.struct(x.alias("v"), k.alias("k"))))
    twice = lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: is_(s, x, k - 1) | is_(s, x, k + 1)), lambda x: x["k"]))
    # a window's words up to the first of the next window
    spans = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    total = lambda p: F.aggregate(spans(p), F.lit(0).cast("long"), lambda a, x: a + x)
    counted = lambda v: F.when(F.size(F.array_distinct(v)) < F.size(v), _let(placed(v), lambda s: _let(twice(s), total))).otherwise(F.lit(0).cast("long"))
    return _let(F.transform(windows, lambda x: F.xxhash64(x)), counted)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)
    and the ratios in ``FEATURES``; columns of these names give way."""
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES}
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    trimmed = F.trim("__t", F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.select(*kept, "__t", F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>")).alias("__w"))
    count = lambda kept: F.length(F.regexp_replace("__t", f"[^{kept}]+", ""))
    lines = _let(F.filter(F.split("__t", "\n"), lambda line: line.rlike("[^ \\t-\\r]")), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    found = {
        "n": F.size("__w"), "c": F.length(F.array_join("__w", "")), "y": count("#*$%&|<>"), "u": count("\\p{Lu}"),
        "l": lines, "r": _repeats(F.col("__w")),
    }
    # a generator, as filters on what is counted aren't pushed below it and computed anew
    rows = rows.select(*kept, F.inline(F.array(F.struct(*(v.alias(f"__{k}") for k, v in found.items())))))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n, c, y, u, r = (F.col(f"__{k}") for k in "ncyur")
    total, repeated = F.col("__l.n"), F.col("__l.n") - F.col("__l.d")
    plain = {"n_words": n, "word_chars": c, "n_symbols": y, "n_dup_lines": repeated, "n_repeat_words": r}
    ratios = {"word_length": per(c, n), "symbols": per(y, n), "upper": per(u, c), "dup_lines": per(repeated, total), "repeats": per(r, n)}
    return rows.select(*kept, *(x.cast("long").alias(k) for k, x in plain.items()), *(x.alias(k) for k, x in ratios.items()))


def base_failed(fewest: int = 10, most_repeated: int = 20) -> Column:
    return (F.col("n_words") < fewest) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def _holds(rule: Rule, row: dict) -> bool:
    return all(row[f] > t if sign == ">" else row[f] <= t for f, sign, t in rule)


def _cuts(rows: list[dict], feature: str, most: int = 48) -> list[float]:
    values = sorted(r[feature] for r in rows)
    picked = {values[k * (len(values) - 1) // most] for k in range(most + 1)}
    distinct = sorted(set(values))
    after = dict(zip(distinct, distinct[1:], strict=False))
    return sorted((v + after[v]) / 2 for v in picked if v in after)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: list[dict], longest: int) -> Rule:
    rule: Rule = []
    while len(rule) < longest:
        p0 = sum(r["poor"] for r in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best, choice = 1e-9, None
        for feature in FEATURES:
            ordered = sorted((r[feature], r["poor"]) for r in rows)
            cuts, k, p, n = _cuts(rows, feature), 0, 0, 0
            for cut in cuts:
                while k < len(ordered) and ordered[k][0] <= cut:
                    p, n, k = p + ordered[k][1], n + 1 - ordered[k][1], k + 1
                for sign, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                    if (g := _gain(a, b, p0, n0)) > best:
                        best, choice = g, (feature, sign, cut)
        if not choice:
            break
        rule.append(choice)
        rows = [r for r in rows if _holds([choice], r)]
    return rule


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """The start of the rule with the best (p - n) / (p + n) on rows that were held back."""
    best, out = -1.0, rule
    for k in range(1, len(rule) + 1):
        hit = [r["poor"] for r in rows if _holds(rule[:k], r)]
        if hit and (worth := (2 * sum(hit) - len(hit)) / len(hit)) > best:
            best, out = worth, rule[:k]
    return out


def learn(rows: list[dict], most_rules: int = 12, longest: int = 4) -> list[Rule]:
    """Ordered rules for ``poor`` rows, by sequential covering."""
    rules: list[Rule] = []
    while len(rules) < most_rules and any(r["poor"] for r in rows):
        grow, hold = [r for r in rows if r["fold"] % 3], [r for r in rows if r["fold"] % 3 == 0]
        rule = _prune(_grow(grow, longest), hold)
        hit = [r["poor"] for r in hold if _holds(rule, r)] if rule else []
        if len(hit) < SUPPORT or sum(hit) < PRECISION * len(hit):
            break
        rules.append(rule)
        rows = [r for r in rows if not _holds(rule, r)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for texts to keep: the first rule that holds rejects."""
    out = F
    for rule in rules:
        test = F.lit(True)
        for feature, sign, cut in rule:
            test &= F.col(feature) > cut if sign == ">" else F.col(feature) <= cut
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def matched(rules: list[Rule]) -> Column:
    """The rule that rejects, in words; null for texts to keep."""
    tests = [" AND ".join(f"{f} {sign} {cut:.6g}" for f, sign, cut in rule) for rule in rules]
    return F.coalesce(*(F.when(~verdict([r]), F.lit(t)) for r, t in zip(rules, tests, strict=True)), F.lit(None).cast("string"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", n_docs: int = FIT_DOCS) -> list[Rule]:
    """Rules from at most ``n_docs`` labelled documents (0 is poor), drawn by a hash of ``key``."""
    known = labels.groupBy(F.col(key).alias("__key")).agg(F.min(label).alias("least"), F.max(label).alias("most")).filter("least = most")
    drawn = known.orderBy(F.xxhash64("__key"), "__key").limit(n_docs).select("__key", (F.col("least") == 0).cast("int").alias("poor"))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(drawn), "__key")
    found = statistics(rows, "__text").filter(~base_failed()).select("__key", "poor", *FEATURES).distinct()
    # at most n_docs rows of numbers, unless keys repeat
    rows = found.withColumn("fold", F.pmod(F.xxhash64("__key", F.lit(1)), F.lit(3))).orderBy("__key", *FEATURES).limit(n_docs).collect()
    return learn([r.asDict() for r in rows])


def rate(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with the statistics, base_failed, kept and rule (what rejects)."""
    rows = statistics(docs, text).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules)).withColumn("rule", matched(rules))
