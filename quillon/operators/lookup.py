"""Lookups by key and by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def neighbour(rows: DataFrame, keys: list[str], order: str, item: str, step: int = 1, wrap: bool = True) -> DataFrame:
    """rows with `neighbour`: the item so many places on in its group, from the other end again if wrap."""
    own = Window.partitionBy(*keys)
    moved = (F.lead(item, step) if step > 0 else F.lag(item, -step)).over(own.orderBy(order))
    if not wrap:
        return rows.withColumn("neighbour", moved)
    n, at = F.count("*").over(own), F.row_number().over(own.orderBy(order)) - 1
    if abs(step) == 1:  # only one row has to look at the other end, so one window is enough
        end = F.min_by(item, order) if step > 0 else F.max_by(item, order)
        last = F.max(order) if step > 0 else F.min(order)
        return rows.withColumn("neighbour", F.when(F.col(order) == last.over(own), end.over(own)).otherwise(moved))
    numbered = rows.withColumn("__at", at).withColumn("__to", F.pmod(at + step, n))
    targets = numbered.select(*keys, F.col("__at").alias("__to"), F.col(item).alias("neighbour"))
    return numbered.join(targets, [*keys, "__to"]).select(*rows.columns, "neighbour")


def match_first(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with `matches`: whether their value equals that of the first row of their key."""
    first = rows.groupBy(key).agg(F.min_by(value, order).alias("__first"))
    return rows.join(first, key).withColumn("matches", F.col(value).eqNullSafe(F.col("__first"))).drop("__first")


def dangling(links: DataFrame, targets: DataFrame, link: str, target: str) -> DataFrame:
    """links whose value no target has, by case and letter."""
    return links.join(targets, links[link] == targets[target], "left_anti")


def with_parent(parent: DataFrame, items: str, carried: dict[str, str]) -> DataFrame:
    """One row for each item of an array column, with parent columns (name: column of the parent); no shuffle."""
    return parent.select(F.posexplode(items).alias("pos", "item"), *[F.col(source).alias(name) for name, source in carried.items()])


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """For each key its row that is last in the order; the columns of rows."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(key, *[f"r.{c}" for c in rest]).select(*rows.columns)


def pick_random(rows: DataFrame, seed: int | None = None) -> DataFrame:
    """One row, each as likely; none of an empty table."""
    return rows.orderBy(F.rand(seed)).limit(1)


def at_position(items: Column, position: Column) -> Column:
    """The item at a position from 0; null for a position below 0 or behind the last."""
    return F.get(items, position)


def joined_lists(*lists: Column) -> Column:
    """Lists one behind another; a null list has nothing."""
    return F.flatten(F.array(*[F.coalesce(x, F.array()) for x in lists]))


def merged_options(*maps: Column) -> Column:
    """Maps laid over each other, later ones winning; null maps are left out."""
    entries = F.flatten(F.array(*[F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps]))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def deep_merged(*maps: Column) -> Column:
    """Nested options laid over each other, as maps from paths ('size.width') to values, later ones winning.

    An option that a later map sets takes the place of the same option, of all options below it, and of a plain
    value above it; what lies beside it stays. Null maps are left out.
    """

    def clash(a: Column, b: Column) -> Column:
        below = lambda x, y: F.startswith(x, F.concat(y, F.lit(".")))
        return (a == b) | below(a, b) | below(b, a)

    def over(held: Column, later: Column) -> Column:
        stays = F.map_filter(held, lambda k, _: ~F.exists(F.map_keys(later), lambda other: clash(k, other)))
        return F.when(later.isNull(), held).otherwise(F.map_concat(stays, later))

    merged = F.coalesce(maps[0], F.create_map().cast("map<string,string>"))
    for later in maps[1:]:
        merged = over(merged, later)
    return merged
