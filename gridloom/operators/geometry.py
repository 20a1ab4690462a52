"""Order-dependent and positional operators on columns: line and gap groups,
coordinates, boxes, captions and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distances of the page layout, in points.
LAYOUT = {
    "line": 3.0, "coordinate": 1.0, "group_gap": 18.0, "cell": 1.5, "header_reach": 180.0, "header_gap": 8.0, "rotated": 3.0, "gutter": 6.0, "gutter_share": 0.6,
    "gutter_overlap": 4.0, "section": 2.0, "label_gap_low": -1.0, "label_gap_high": 18.0, "card_rule_width": 80.0, "card_rule_height": 3.0, "image_width": 30.0,
    "image_height": 25.0, "card_heading": 25.0, "image_row": 12.0, "card_text": 50.0,
}


def gap_groups(df: DataFrame, keys: list[str], start: str, end: str, gap: float, tie: str) -> DataFrame:
    """Adds ``group`` (from 0 within ``keys``): a new one begins more than
    ``gap`` after everything before it has ended."""
    order = Window.partitionBy(*keys).orderBy(start, tie)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) - reach <= gap), 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn("group", F.sum("_fresh").over(order)).drop("_fresh")


def anchor_fold(values: Column, tolerance: float) -> Column:
    """array<double>: for each of the sorted ``values`` the first value of its
    line; a line ends where a value is more than ``tolerance`` from that first."""
    start = F.struct(F.lit(None).cast("double").alias("at"), F.array().cast("array<double>").alias("out"))

    def step(acc, v):
        at = F.when(acc["at"].isNull() | (F.abs(v - acc["at"]) > tolerance), v).otherwise(acc["at"])
        return F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def unique_coordinates(values: Column, tolerance: float = LAYOUT["coordinate"]) -> Column:
    """Sorted coordinates; one within ``tolerance`` of the last becomes its mean with it."""

    def step(acc, v):
        last = F.try_element_at(acc, F.lit(-1))
        near = F.coalesce(F.abs(v - last) <= tolerance, F.lit(False))
        return F.when(near, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), (last + v) / 2.0)).otherwise(F.array_append(acc, v))

    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), step)


def _bins(low: Column, high: Column, width: float | None) -> Column:
    """The bins that a range lies in; one for all without a width."""
    return F.explode(F.sequence(F.floor(low / width), F.floor(F.greatest(low, high) / width)) if width else F.array(F.lit(0).cast("long"))).alias("_bin")


def _bin(value: Column, width: float | None) -> Column:
    return F.floor(value / width) if width else F.lit(0).cast("long")


def in_box(points: DataFrame, boxes: DataFrame, keys: list[str], x: str, y: str, box: tuple[str, str, str, str] = ("x0", "top", "x1", "bottom"), width: float | None = None) -> DataFrame:
    """Points with the boxes of the same ``keys`` that hold them, edges included.
    With a ``width``, about that of a box, points meet the boxes near them only."""
    x0, top, x1, bottom = box
    near = points.withColumn("_bin", _bin(F.col(x), width)).join(boxes.select("*", _bins(F.col(x0), F.col(x1), width)), [*keys, "_bin"]).drop("_bin")
    return near.filter(F.col(x).between(F.col(x0), F.col(x1)) & F.col(y).between(F.col(top), F.col(bottom)))


def outside(points: DataFrame, spans: DataFrame, key: str, value: str, low: str, high: str, width: float | None = None) -> DataFrame:
    """Points that no span of their ``key`` holds; ``width`` as for ``in_box``."""
    other = spans.select(F.col(key).alias("_k"), F.col(low).alias("_lo"), F.col(high).alias("_hi"), _bins(F.col(low), F.col(high), width))
    return points.join(other, (F.col(key) == F.col("_k")) & (_bin(F.col(value), width) == F.col("_bin")) & F.col(value).between(F.col("_lo"), F.col("_hi")), "left_anti")


def nearest_before(df: DataFrame, keys: list[str], order: list[str], is_target: Column, is_source: Column, value: str) -> DataFrame:
    """Target rows with ``nearest``: the value of the last source row before them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("nearest", F.last(F.when(is_source, F.col(value)), ignorenulls=True).over(w)).filter(is_target)


def nearest_anchor(values: DataFrame, anchors: list[float], value: str) -> DataFrame:
    """Adds ``anchor``, the place (from 0) of the nearest of few anchors; of equally near ones the first."""
    each = F.array(*[F.struct(F.abs(F.col(value) - a).alias("d"), F.lit(i).alias("i")) for i, a in enumerate(anchors)])
    return values.withColumn("anchor", F.array_min(each)["i"])


def merge_statuses(statuses: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One status per ``keys``: STANDARD before OPTION before NOT_AVAILABLE, of equal ones the first."""
    rank = F.when(F.col("status") == "STANDARD", 2).when(F.col("status") == "OPTION", 1).otherwise(0)
    return statuses.groupBy(*keys).agg(F.max_by(F.struct("status", "price"), F.struct(rank, -F.col(order))).alias("_s")).select(*keys, "_s.status", "_s.price")
