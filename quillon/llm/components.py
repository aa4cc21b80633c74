"""Connected components of a table of links, by repeated contraction.

In each round every node looks at the least of itself and its neighbours, twice follows these choices, and links are
rewritten between the nodes so chosen; rounds end when no link is left. Links shrink by half or more in a round, so the
number of rounds follows the logarithm of the longest chain. A hot node (the centre of a star with a third of all links)
is folded by map tasks before the shuffle, and joins have one row for each node on their other side, so Spark can split
the hot side. Rounds end in tables in the shared folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import Scratch


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id and component (its least id) of every node that a link between two different ids (columns a and b) names."""
    links = scratch.keep(_links(pairs.select("a", "b")), f"{name}-links-0")
    chosen: list[DataFrame] = []
    while not links.isEmpty():
        r = len(chosen) + 1
        both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
        least = scratch.keep(both.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("up")), f"{name}-least-{r}")
        ups = least.select(F.col("id").alias("up"), F.col("up").alias("above"))
        chosen.append(scratch.keep(least.join(ups, "up").select("id", F.col("above").alias("to")), f"{name}-chosen-{r}"))
        of = chosen[-1]
        moved = (
            links.join(of.select(F.col("id").alias("a"), F.col("to").alias("to_a")), "a")
            .join(of.select(F.col("id").alias("b"), F.col("to").alias("to_b")), "b")
            .select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        )
        links = scratch.keep(_links(moved), f"{name}-links-{r}")
        scratch.drop(f"{name}-least-{r}")
        scratch.drop(f"{name}-links-{r - 1}")
    if not chosen:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = chosen[0].select("id", F.col("to").alias("component"))
    for of in chosen[1:]:
        labels = labels.join(of.select(F.col("id").alias("component"), "to"), "component", "left").select(
            "id", F.coalesce("to", "component").alias("component")
        )
    return labels
