"""Connected components as joins and aggregates, for graphs that fit no single machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import discard, written


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, root): root is the smallest node of the component.

    Each round hooks every node to its smallest neighbour, shortens the resulting
    chains by two pointer jumps, and contracts the links to the new names. Links
    inside a contracted node vanish, so the rounds end when none is left. Hooks
    only ever lead to smaller nodes, so the smallest node keeps its own name.
    Every neighbourhood is met by a partial aggregate, never gathered. Nodes
    without a link do not appear; an empty input gives an empty result.
    """
    links = written(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    names = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
        hook = written(hook, "hooks")
        jump = hook
        for _ in range(2):
            up = jump.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jump = jump.join(up, "root").select("node", F.col("top").alias("root"))
        jump = written(jump, "jumps")
        to = lambda c: jump.select(F.col("node").alias(c), F.col("root").alias(f"{c}2"))  # noqa: B023, E731
        smaller = (
            links.join(to("a"), "a")
            .join(to("b"), "b")
            .where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct()
        )
        smaller = written(smaller, "links")
        if names is None:
            merged = jump
        else:
            moved = jump.select(F.col("node").alias("root"), F.col("root").alias("top"))
            merged = written(
                names.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "names"
            )
            discard(names)
        discard(links)
        discard(hook)
        if names is not None:
            discard(jump)
        links, names = smaller, merged
    if names is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names
