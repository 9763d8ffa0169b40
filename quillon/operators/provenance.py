"""Where a field was printed: boxes of tokens as JSON without floats, and its validation.

A field's provenance names page, lines and tokens, the box around them as exact decimal
texts and the same as shares of the page; what lies on further pages is a list of such
spans.  Validation reads the JSON as VARIANT: its schema tells at once whether a field has
just the keys it must have, of the types they must have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The schema's name, and the shape of a span and of a field, keys in order.
SCHEMA = "field-provenance-v1"
_SPAN = "bbox: ARRAY<STRING>, line_ordinals: ARRAY<BIGINT>, normalized_bbox: ARRAY<STRING>, page_height: STRING, page_ordinal: BIGINT, page_width: STRING, token_ordinals: ARRAY<BIGINT>"
_FIELD = "OBJECT<additional_page_spans: ARRAY<{}>, band_relation: STRING, bbox: ARRAY<STRING>, line_ordinals: ARRAY<BIGINT>, normalized_bbox: ARRAY<STRING>, page_height: STRING, page_ordinal: BIGINT, page_width: STRING, role: STRING, token_ordinals: ARRAY<BIGINT>>"
_READ = "struct<bbox:array<string>,line_ordinals:array<bigint>,normalized_bbox:array<string>,page_height:string,page_ordinal:bigint,page_width:string,token_ordinals:array<bigint>{}>"
_SPAN_TYPE = _READ.format("")
_FIELD_TYPE = _READ.format(f",role:string,band_relation:string,additional_page_spans:array<{_SPAN_TYPE}>")
_DECIMAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"


def fields(tokens: DataFrame, *by: str) -> DataFrame:
    """Tokens (``by``, field, role, page, line, ordinal, x0, y0, x1, y1, width, height; decimals
    with two places) to the JSON of each ``by``'s fields: ``provenance``."""
    money = lambda c: c.cast("decimal(20,2)").cast("string")
    share = lambda c, whole: F.bround(c.cast("decimal(20,10)") / whole.cast("decimal(20,10)"), 6).cast("decimal(8,6)").cast("string")
    ordered = lambda c: F.sort_array(F.array_distinct(F.collect_list(F.col(c).cast("bigint"))))
    # one exchange by the whole serves its spans, fields and JSON
    span = tokens.repartition(*by).groupBy(*by, "field", "role", "page").agg(ordered("line").alias("line_ordinals"), ordered("ordinal").alias("token_ordinals"), F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d"), F.max("width").alias("w"), F.max("height").alias("h"))
    edges = [F.col(x) for x in "abcd"]
    whole = [F.col(x) for x in "whwh"]
    made = F.struct(
        F.col("page").cast("bigint").alias("page_ordinal"), "line_ordinals", "token_ordinals", F.array(*map(money, edges)).alias("bbox"), money(F.col("w")).alias("page_width"), money(F.col("h")).alias("page_height"),
        F.array(*(share(e, x) for e, x in zip(edges, whole, strict=True))).alias("normalized_bbox"),
    )
    spans = span.groupBy(*by, "field", "role").agg(F.sort_array(F.collect_list(made)).alias("s"))
    first = F.get("s", F.lit(0))
    relation = F.when(F.size("s") > 1, "across_pages").otherwise("inside")
    one = F.struct(*(first[n].alias(n) for n in ("page_ordinal", "line_ordinals", "token_ordinals", "bbox", "page_width", "page_height", "normalized_bbox")), F.col("role"), relation.alias("band_relation"), F.slice("s", 2, 1 << 30).alias("additional_page_spans"))
    named = spans.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", one.alias("value"))))).alias("fields"))
    return named.select(*by, F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), "fields")).alias("provenance"))


def _exact(c: Column) -> Column:
    return F.coalesce(c.rlike(_DECIMAL), F.lit(False))


def _box(texts: Column) -> Column:
    """Whether a box has four exact edges that don't cross."""
    edge = lambda k: F.get(texts, F.lit(k)).try_cast("decimal(38,10)")
    return F.coalesce((edge(0) <= edge(2)) & (edge(1) <= edge(3)), F.lit(False))


def _span_code(s: Column) -> Column:
    number = lambda c: c.try_cast("decimal(38,10)")
    ordinals = lambda c: (F.size(c) > 0) & F.forall(c, lambda n: n > 0) & (F.size(F.array_distinct(c)) == F.size(c))
    four = lambda c: F.size(c) == 4
    box, shares, width, height = s["bbox"], s["normalized_bbox"], s["page_width"], s["page_height"]
    return (
        F.when(s["page_ordinal"] <= 0, "provenance_ordinal_invalid").when(~ordinals(s["line_ordinals"]) | ~ordinals(s["token_ordinals"]), "provenance_ordinals_invalid")
        .when(~four(box), "provenance_bbox_invalid").when(~F.forall(box, _exact), "provenance_decimal_invalid").when(F.exists(box, lambda x: number(x) < 0) | ~_box(box), "provenance_bbox_invalid")
        .when(~_exact(width) | ~_exact(height), "provenance_decimal_invalid").when((number(width) <= 0) | (number(height) <= 0), "provenance_dimension_invalid")
        .when(~four(shares), "provenance_normalized_bbox_invalid").when(~F.forall(shares, _exact), "provenance_decimal_invalid")
        .when(F.exists(shares, lambda x: (number(x) < 0) | (number(x) > 1)), "provenance_normalized_bbox_invalid").when(~_box(shares), "provenance_bbox_invalid")
        .when((number(F.get(box, F.lit(2))) > number(width)) | (number(F.get(box, F.lit(3))) > number(height)), "provenance_bbox_invalid")
    )


def violations(rows: DataFrame, key: str, json: str = "provenance") -> DataFrame:
    """``key``, field (null for the whole) and code of each payload or field that isn't valid."""
    read = rows.select(F.col(key), F.try_parse_json(json).alias("v")).withColumn("shape", F.schema_of_variant("v"))
    whole = (
        F.when(F.col("v").isNull() | ~F.coalesce(F.col("shape").rlike("^OBJECT<fields: .*, schema: [A-Z]+>$"), F.lit(False)), "provenance_payload_invalid")
        .when(~F.coalesce(F.try_variant_get("v", "$.schema", "string") == SCHEMA, F.lit(False)) | ~F.col("shape").endswith("schema: STRING>"), "provenance_schema_unsupported")
        .when(~F.col("shape").startswith("OBJECT<fields: OBJECT<"), "provenance_fields_invalid")
    )
    # one row for a whole without fields, else one a field; exploding isn't pushed down as a filter is, so that the JSON is read once
    entry = lambda field, value, code: F.struct(field.alias("field"), value.alias("value"), code.alias("whole"))
    none = F.lit(None)
    each = F.transform(F.map_entries(F.try_variant_get("v", "$.fields", "map<string,variant>")), lambda e: entry(e["key"], e["value"], none.cast("string")))
    read = read.withColumn("code", whole)
    entries = F.when(F.col("code").isNull(), each).otherwise(F.array(entry(none.cast("string"), none.cast("variant"), F.col("code"))))
    each = read.select(key, F.inline(entries))
    # a path of its own, as a key's name may equal the column's
    each = each.withColumn("shape", F.schema_of_variant("value"))
    shaped = F.col("shape").isin(_FIELD.format("VOID"), _FIELD.format(f"OBJECT<{_SPAN}>"), _FIELD.format("VOID").replace("ARRAY<VOID>", "ARRAY<>"))
    each = each.withColumn("f", F.when(shaped, F.try_variant_get("value", "$", _FIELD_TYPE)))
    f = F.col("f")
    pages = F.concat(F.array(f["page_ordinal"]), F.transform(f["additional_page_spans"], lambda s: s["page_ordinal"]))
    text = lambda c: (F.length(c) == 0) | c.contains("\x00")
    code = F.coalesce(
        "whole", F.when(F.length("field") == 0, "provenance_field_name_invalid"), F.when(f.isNull(), "provenance_field_invalid"), _span_code(f), F.when(text(f["role"]) | text(f["band_relation"]), "provenance_text_invalid"),
        F.get(F.array_compact(F.transform(f["additional_page_spans"], _span_code)), F.lit(0)), F.when(F.size(F.array_distinct(pages)) != F.size(pages), "provenance_spans_invalid"),
    )
    return each.select(key, "field", F.explode(F.array_compact(F.array(code))).alias("code"))


def lacking(rows: DataFrame, key: str, required: list[str], json: str = "provenance") -> DataFrame:
    """Fields with a value (columns of ``required``) that the provenance doesn't name."""
    names = F.map_keys(F.from_json(F.get_json_object(json, "$.fields"), "map<string,string>"))
    there = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), n) for n in required)))
    return rows.select(key, F.explode(F.array_except(there, F.coalesce(names, F.array().cast("array<string>")))).alias("field"))
