"""Declarative feature expressions: visibility, paint lookups, interpolation and draw order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions.units import stops
from quadrant.sources.tables import table


def expression(node: object) -> Column:
    """A column from a nested list expression: ['all', ['==', ['get', 'kind'], 'plate'], ['has', 'area_m2']] and the like.

    Operators: all, any, !, ==, !=, <, <=, >, >=, in, has, get, to-boolean, coalesce, literal, match (input, label, value, ..., default),
    case (test, value, ..., default), interpolate (['linear'] or ['exponential', base], input, stop, value, ...). Comparisons are null-safe: nothing equals what is absent.
    """
    if not isinstance(node, list):
        return F.lit(node)
    op, *rest = node
    if op == "literal":
        return F.lit(rest[0])
    if op == "get":
        return F.col(rest[0])
    if op == "has":
        return F.col(rest[0]).isNotNull()
    if op == "interpolate":
        base = rest[0][1] if rest[0][0] == "exponential" else 1.0
        return stops(expression(rest[1]).cast("double"), list(zip(rest[2::2], rest[3::2], strict=True)), base)
    if op == "match":
        pairs, value = list(zip(rest[1:-1:2], rest[2:-1:2], strict=True)), expression(rest[0])
        result = expression(rest[-1])
        for labels, out in reversed(pairs):
            result = F.when(value.isin(labels if isinstance(labels, list) else [labels]), expression(out)).otherwise(result)
        return result
    if op == "case":
        result = expression(rest[-1])
        for test, out in reversed(list(zip(rest[:-1:2], rest[1:-1:2], strict=True))):
            result = F.when(expression(test), expression(out)).otherwise(result)
        return result
    if op == "in":
        return F.coalesce(expression(rest[0]).isin(rest[1]), F.lit(False))
    parts = [expression(r) for r in rest]
    if op in ("all", "any"):
        return reduce((lambda a, b: a & b) if op == "all" else (lambda a, b: a | b), [F.coalesce(p, F.lit(False)) for p in parts], F.lit(op == "all"))
    if op == "!":
        return ~F.coalesce(parts[0], F.lit(False))
    if op == "to-boolean":
        return F.coalesce(parts[0].cast("boolean"), F.lit(False))
    if op == "coalesce":
        return F.coalesce(*parts)
    a, b = parts
    return {"==": lambda: a.eqNullSafe(b), "!=": lambda: ~a.eqNullSafe(b), ">": lambda: F.coalesce(a > b, F.lit(False)), ">=": lambda: F.coalesce(a >= b, F.lit(False)), "<": lambda: F.coalesce(a < b, F.lit(False)), "<=": lambda: F.coalesce(a <= b, F.lit(False))}[op]()


VISIBLE = ["all", ["!", ["==", ["get", "kind"], "parking"]], ["any", ["has", "area_m2"], [">", ["get", "pt"], 6]]]
SIZE = ["interpolate", ["exponential", 2], ["get", "pt"], 5, 1.0, 8, 4.0, 12, 9.0]
COLOUR = ["match", ["get", "kind"], ["building", "plate"], "brown", "area", "green", ["coalesce", ["get", "source"], "transparent"]]
RANK = ["case", ["==", ["get", "kind"], "area"], 16, [">=", ["get", "lines"], 2], 17, 18]


def feature_visibility(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that are drawn, with colour, size, rank and place in the drawing order."""
    rows = table(spark, folder, "labels", "label_id", "kind", "pt", "lines", "source", "area_m2").filter(expression(VISIBLE))
    return rows.select("label_id", expression(COLOUR).alias("colour"), F.round(expression(SIZE), 6).alias("size"), expression(RANK).alias("rank"))


def visible_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Drawn and hidden labels by kind."""
    rows = table(spark, folder, "labels", "kind", "pt", "area_m2").withColumn("drawn", expression(VISIBLE))
    return rows.groupBy("kind", "drawn").agg(F.count(F.lit(1)).alias("labels"))


QUERIES = {f.__name__: f for f in (feature_visibility, visible_counts)}

_VISIBLE = "(kind IS DISTINCT FROM 'parking') AND (area_m2 IS NOT NULL OR coalesce(pt > 6, false))"
ORACLES = {
    "feature_visibility": f"""SELECT label_id, CASE WHEN kind IN ('building', 'plate') THEN 'brown' WHEN kind = 'area' THEN 'green' ELSE coalesce(source, 'transparent') END AS colour,
round(CASE WHEN pt <= 5 THEN 1.0 WHEN pt < 8 THEN 1.0 + (pow(2.0, pt - 5) - 1) / 7.0 * 3.0 WHEN pt < 12 THEN 4.0 + (pow(2.0, pt - 8) - 1) / 15.0 * 5.0 ELSE 9.0 END, 6) AS size,
CAST(CASE WHEN kind = 'area' THEN 16 WHEN coalesce(lines >= 2, false) THEN 17 ELSE 18 END AS INTEGER) AS rank FROM labels WHERE {_VISIBLE}""",
    "visible_counts": f"SELECT kind, {_VISIBLE} AS drawn, count(*) AS labels FROM labels GROUP BY 1, 2",
}
