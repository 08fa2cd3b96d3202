"""Connected components of a link table.

Each round every node adopts the least node among itself and its neighbours, chains
of adoptions are followed by pointer doubling, and the links are rewritten to the nodes
adopted; links inside a component fall away.  A node that keeps itself was adopted by
its neighbours, so at least half of the linked nodes vanish in a round.  Each step is
written to the shared folder and the tables it replaces are deleted, so neither the plans nor
the disk used grow with the rounds, and a lost executor costs the current step only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.session import discard, materialize


def _distinct_links(links: DataFrame, a: str, b: str) -> DataFrame:
    ends = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b")
    return materialize(ends.distinct(), "links")


def _adopted(links: DataFrame) -> DataFrame:
    """(node, comp, moved): the end of each node's chain of adoptions."""
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    chain = materialize(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "chains")
    while True:
        ahead = chain.select(F.col("node").alias("comp"), F.col("comp").alias("ahead"))
        longer = materialize(chain.join(ahead, "comp").select("node", F.col("ahead").alias("comp"),
                                                              (F.col("comp") != F.col("ahead")).alias("moved")), "chains")
        discard(chain)
        chain = longer
        if chain.where("moved").isEmpty():
            return chain


def components(links: DataFrame) -> DataFrame:
    """(node, comp): every node of the links (columns a and b) with the least node it reaches."""
    links = _distinct_links(links, "a", "b")
    label = None
    while not links.isEmpty():
        step = _adopted(links)
        next_links = _distinct_links(
            links.join(step.select(F.col("node").alias("a"), F.col("comp").alias("to_a")), "a")
                 .join(step.select(F.col("node").alias("b"), F.col("comp").alias("to_b")), "b"), "to_a", "to_b")
        if label is None:
            label = step
        else:
            further = step.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            joined = materialize(label.join(further, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
            discard(label, step)
            label = joined
        discard(links)          # deleted only now that all that read them is written
        links = next_links
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out = label.select("node", "comp")
    out._scratch_path = vars(label).pop("_scratch_path")      # the caller may discard it
    return out
