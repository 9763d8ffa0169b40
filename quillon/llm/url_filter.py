"""URL rules by expanded expressions, hash prefixes and full digests.

A URL is expanded into every host suffix (on a label's border) joined with every path
prefix that could be a rule's; an expression is looked up by the first hex digits of its
SHA-256, and a hit counts only if the full digest agrees.  Of the rules that fit, the
longest wins; of equally long ones that with the longer host, then blocking.

* a null URL, or one without ``://``, has an empty host and path and fits no rule
* repeated rows stay; an empty table gives an empty result; an empty rule table lets every
  URL pass; the input's other columns don't take part
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are sent to all executors up to this number, and dealt out by hash beyond it.
BROADCAST_RULES = 50_000
PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    raw = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Array of structs (host, path): suffixes of these numbers of labels with prefixes of these lengths."""
    n = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.filter(F.array(*(F.when(n >= k, F.substring_index(host, ".", -k)) for k in labels)), lambda s: s.isNotNull())
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("h"), p.alias("p")))))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict.

    ``rules`` has columns host, path (empty, or with its first slash) and verdict.
    Columns of ``pages`` with the new columns' names give way.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col("__url"))
    digest = F.sha2(F.concat("h", "p"), 256)
    # expanded and hashed where the pages are read; only hits are grouped by URL
    urls = pages.select(F.col(url).alias("__url")).filter(F.col("__url").isNotNull())
    # as many rows as rules have different shapes: only such suffixes and prefixes are made, so a host of thousands of labels is no burden
    shapes = rules.select(F.size(F.split("host", r"\.")), F.length("path")).distinct().collect()
    labels, lengths = sorted({r[0] for r in shapes}), sorted({r[1] for r in shapes})
    if lengths:
        table = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict").withColumn("digest", digest)
        table = table.groupBy("digest").agg(F.max(F.struct(F.col("verdict") != "allow", "verdict", F.concat("h", "p"), F.length("h"))).alias("r"))
        table = table.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
        if table.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
            table = F.broadcast(table)
        asked = urls.select("__url", F.explode(expressions(host, path, labels, lengths)).alias("e")).select("__url", "e.h", "e.p")
        asked = asked.select("__url", digest.alias("asked")).withColumn("prefix", F.substring("asked", 1, PREFIX_DIGITS))
        hits = asked.join(table, "prefix").filter(F.col("asked") == F.col("digest"))
        best = F.max(F.struct(F.length("r.col3").alias("n"), F.col("r.col4").alias("k"), F.col("r.col1").alias("b"), F.col("r.col3").alias("rule"), F.col("r.verdict").alias("verdict")))
        found = hits.groupBy("__url").agg(best.alias("best")).select("__url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    else:
        found = urls.limit(0).select("__url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    # rows without a URL are spread over the tasks
    spread = F.when(F.col("__url").isNull(), F.rand()).otherwise(0.0)
    out = pages.select(*kept, F.col(url).alias("__url")).withColumn("__spread", spread).join(found.withColumn("__spread", F.lit(0.0)), ["__url", "__spread"], "left")
    return out.select(*kept, host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
