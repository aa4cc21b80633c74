"""Templates: one text for each row, and one text for each group of rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import fill, portion, price

CATEGORY_TILE = '<div class="tile"><a href="#{{short_name}}"><img src="images/{{short_name}}.jpg" alt="{{name}}"><span>{{name}}</span></a></div>'
ITEM_TILE = (
    '<div class="item"><b>{{short_name}}</b><h3>{{name}}</h3><p>{{description}}</p>'
    "<span>{{price_small}} {{small_portion}} {{price_large}} {{large_portion}}</span></div>"
)
#: After every second item.
ROW_END = '<div class="clear"></div>'


def category_tile(name: Column, short_name: Column) -> Column:
    return fill(CATEGORY_TILE, name=name, short_name=short_name)


def item_tile(item: dict[str, Column]) -> Column:
    """item: short_name, name, description, price_small, price_large, small_portion, large_portion."""
    shown = {k: price(v) if k.startswith("price") else portion(v) if k.endswith("portion") else v for k, v in item.items()}
    return fill(ITEM_TILE, **shown)


#: Blocks that the positions of a table are cut into at most.
BLOCKS = 64


def in_blocks(rows: DataFrame, order: str, blocks: int = BLOCKS) -> Column:
    """The block of a row by its position: about equal shares of the table. Positions that are no numbers are one block."""
    if dict(rows.dtypes)[order] not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return F.lit(0)
    shares = [k / blocks for k in range(1, blocks)]
    cuts = rows.agg(F.percentile_approx(order, F.array(*map(F.lit, shares))).alias("cuts")).first()["cuts"] or []
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(order))), F.lit(0)) if cuts else F.lit(0)


def fold(rows: DataFrame, keys: list[str], order: str, html: Column, before: str = "", after: str = "", row_end: str = ROW_END) -> DataFrame:
    """keys and html: the pieces of a group in order, with row_end after every second one.

    A group is folded in blocks of positions, each by a task of its own, and then block by block; only the texts of blocks, with
    row_end where their own first piece is the group's first or second, meet in one place. Pieces of one position go in the
    order of their text; a null piece counts as a piece and adds nothing.
    """
    pieces = rows.select(*keys, F.col(order).alias("__at"), html.alias("__html"), in_blocks(rows, order).alias("__block"))
    nth = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy("__at", "__html")) - 1
    piece = lambda odd: F.concat(F.coalesce("__html", F.lit("")), F.when(F.col("__nth") % 2 == odd, F.lit(row_end)).otherwise(F.lit("")))
    listed = lambda of, by: F.expr(f"listagg({of}, '') within group (order by {by})")
    even, odd = piece(1).alias("__even"), piece(0).alias("__odd")
    blocks = pieces.withColumn("__nth", nth).select(*keys, "__block", "__nth", even, odd).groupBy(*keys, "__block")
    blocks = blocks.agg(F.count("*").alias("__n"), listed("__even", "__nth").alias("__even"), listed("__odd", "__nth").alias("__odd"))
    before_it = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    placed = blocks.withColumn("__text", F.when(F.coalesce(before_it, F.lit(0)) % 2 == 0, F.col("__even")).otherwise(F.col("__odd")))
    return placed.groupBy(*keys).agg(listed("__text", "__block").alias("__all")).select(*keys, F.concat(F.lit(before), "__all", F.lit(after)).alias("html"))
