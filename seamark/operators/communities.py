"""Communities by modularity: local moving and contraction, level by level.

At each level nodes move to the neighbouring community that raises modularity
most. All moves of a round are made at once from the same sums, so in each
round only the nodes of one half (by a hash of node and round) may move, which
keeps neighbours from trading places, and the best state of a level is kept.
Communities then become the nodes of the next level, until none is merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.operators.graph import ensure_checkpoint_dir, written


def undirected(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights ``a``, ``b``, ``w`` in both directions, summed over repeated edges, and loops ``a``, ``w`` (both ends counted)."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    e = edges.where("src is not null and dst is not null").select("src", "dst", weight.alias("w"))
    both = e.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "w")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    loops = e.where("src = dst").groupBy(F.col("src").alias("a")).agg(F.sum(2 * F.col("w")).alias("w"))
    return both, loops


def modularity(adjacent: DataFrame, loops: DataFrame, state: DataFrame, total: float) -> float:
    """Modularity of ``state`` (``node``, ``c``, ``k``); ``total`` is the sum of all degrees."""
    own = state.select("node", "c")
    inside = adjacent.join(own, F.col("a") == F.col("node")).select("b", "w", F.col("c").alias("ca")).join(own.withColumnsRenamed({"node": "b", "c": "cb"}), "b")
    within = (inside.where("ca = cb").agg(F.sum("w")).first()[0] or 0.0) + (loops.agg(F.sum("w")).first()[0] or 0.0)
    apart = state.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.pow(F.col("t") / total, 2.0))).first()[0] or 0.0
    return within / total - apart


def _moved(adjacent: DataFrame, state: DataFrame, total: float, resolution: float, turn: int) -> DataFrame:
    """``state`` after the moves of one round."""
    sums = state.groupBy("c").agg(F.sum("k").alias("t"))
    there = adjacent.join(state.select(F.col("node").alias("b"), "c"), "b").select(F.col("a").alias("node"), "c", "w")
    links = there.unionByName(state.select("node", "c", F.lit(0.0).alias("w"))).groupBy("node", "c").agg(F.sum("w").alias("w"))
    rated = links.join(sums, "c").join(state.select("node", F.col("c").alias("own"), "k"), "node")
    others = F.col("t") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("w") - resolution * F.col("k") * others / total, 9)
    best = rated.withColumn("g", gain).groupBy("node", "own", "k").agg(F.max(F.struct("g", (F.col("c") == F.col("own")).alias("stay"), "c")).alias("best"))
    may = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
    return best.select("node", F.when(may, F.col("best.c")).otherwise(F.col("own")).alias("c"), "k", (may & (F.col("best.c") != F.col("own"))).alias("moved"))


def _settled(adjacent: DataFrame, state: DataFrame, total: float, resolution: float, rounds: int) -> DataFrame:
    """``state`` once hardly any node moves in two rounds."""
    count, quiet = state.count(), 0
    for turn in range(rounds):
        state = written(_moved(adjacent, state, total, resolution, turn))
        quiet = quiet + 1 if state.where("moved").count() <= count // 1000 else 0
        if quiet == 2:
            break
    return state


def _contracted(adjacent: DataFrame, loops: DataFrame, belongs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph whose nodes are the communities of ``belongs`` (``node``, ``c``)."""
    ends = adjacent.join(belongs.withColumnsRenamed({"node": "a", "c": "ca"}), "a").join(belongs.withColumnsRenamed({"node": "b", "c": "cb"}), "b")
    ends = written(ends.groupBy("ca", "cb").agg(F.sum("w").alias("w")))
    own = loops.join(belongs, F.col("a") == F.col("node")).select(F.col("c").alias("a"), "w")
    inner = written(own.unionByName(ends.where("ca = cb").select(F.col("ca").alias("a"), "w")).groupBy("a").agg(F.sum("w").alias("w")))
    return ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w"), inner


def _named(state: DataFrame) -> DataFrame:
    """``node``, ``c``: a community is known by its smallest node, so that names do not depend on the moves."""
    return written(state.join(state.groupBy("c").agg(F.min("node").alias("name")), "c").select("node", F.col("name").alias("c")))


def modularity_communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 8, levels: int = 12, cycles: int = 2) -> DataFrame:
    """``node``, ``community`` (its smallest node) by modularity.

    ``edges`` has ``src``, ``dst`` and maybe ``weight``; direction does not
    count, repeated edges add up, edges with a null end are left out. Local
    moving takes ``rounds`` rounds at most. When no level gains any more, the
    single nodes move once more between the communities that were found, and
    if that gains, the levels begin again from there, ``cycles`` times at most.
    The result is the same on every run.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    adjacent, loops = undirected(edges)
    adjacent, loops = written(adjacent), written(loops)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    best = written(nodes.select("node", F.col("node").alias("c")))
    weights = adjacent.select(F.col("a").alias("node"), "w").unionByName(loops.select(F.col("a").alias("node"), "w"))
    degrees = written(weights.groupBy("node").agg(F.sum("w").alias("k")))
    total = degrees.agg(F.sum("k")).first()[0] or 0.0

    def scored(belongs: DataFrame) -> float:
        return modularity(adjacent, loops, belongs.join(degrees, "node"), total)

    score = scored(best) if total else 0.0
    for _ in range(cycles if total else 0):
        start = score
        for level in range(levels):
            near, own = (adjacent, loops) if level == 0 else _contracted(adjacent, loops, best)
            begin = best if level == 0 else best.select(F.col("c").alias("node"), "c").distinct()
            k = near.select(F.col("a").alias("node"), "w").unionByName(own.select(F.col("a").alias("node"), "w")).groupBy("node").agg(F.sum("w").alias("k"))
            state = written(begin.join(k, "node").select("node", "c", "k", F.lit(False).alias("moved")))
            moved = _named(_settled(near, state, total, resolution, rounds))
            # a node without edges takes no part and stays
            by = best.withColumn("part", F.col("node" if level == 0 else "c"))
            new = written(by.join(moved.select(F.col("node").alias("part"), F.col("c").alias("up")), "part", "left").select("node", F.coalesce("up", "c").alias("c")))
            now = scored(new)
            if now <= score + 1e-9:
                if level:
                    break
                continue
            best, score = new, now
        if score <= start + 1e-9:
            break
    return best.select("node", F.col("c").alias("community"))
