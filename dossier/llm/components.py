"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import cut


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least v of each u.

    The least is aggregated before the shuffle. The join back is by u: of a hub it is one row to many, and Spark's
    skewed join handling deals the many over tasks.
    """
    least = pairs.groupBy(F.col("u").alias("u_")).agg(F.min("v").alias("m"))
    return pairs.join(least, F.col("u") == F.col("u_")).drop("u_")


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> node, root: the least node that each linked node reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until every node points at its root. Each round
    ends in the shared folder; the driver sees two numbers a round. Loops and repeated links do no harm; nodes without
    links are not returned. No links: no rows.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        found = _with_least(starred)
        pairs = cut(
            found.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v"))).distinct(),
            "components",
        )
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
