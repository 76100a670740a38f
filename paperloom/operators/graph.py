"""The evidence graph: claims, documents, facts and parties, and what they support, contradict, reference, respond to or cause.

Edges are rows (source_id, target_id, relationship_type). Walks go in rounds, one for each hop: the frontier of the round before
meets the edges, and what it finds is written down, so a lost executor costs a round at most. Nodes with more than HUB edges are
split: their edges are dealt by the hash of the target, and only rows of a frontier that stand at such a node are copied to its parts.
`reach` writes only frontiers of nodes from which edges go on; what a walk ends at passes one shuffle, in lists of targets, and meets as arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import kept

#: Edges that a node brings into one part of a join.
HUB = 10_000


#: Nodes that a seed's walks go on from, at most, for what they end at to be held in arrays.
CROWD = 1_000


class _Edges:
    """Distinct edges by source, those of hubs in parts."""

    def __init__(self, edges: DataFrame, hub: int):
        pairs = kept(edges.where("source_id is not null and target_id is not null").select("source_id", "target_id").distinct(), "graph-pairs")
        degrees = pairs.groupBy("source_id").agg(F.count("*").alias("degree")).where(F.col("degree") > hub)
        self.hubs = kept(degrees.select("source_id", F.ceil(F.col("degree") / hub).cast("int").alias("parts")), "graph-hubs")
        dealt = pairs.join(self.hubs, "source_id", "left")
        part = F.coalesce(F.pmod(F.xxhash64("target_id"), F.col("parts")), F.lit(0)).cast("int")
        self.pairs = kept(dealt.select("source_id", "target_id", part.alias("part")), "graph-edges")

    def step(self, frontier: DataFrame) -> DataFrame:
        """The frontier's rows with each target of their node."""
        at = frontier.join(self.hubs.withColumnRenamed("source_id", "node"), "node", "left")
        at = at.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return at.join(self.pairs.withColumnRenamed("source_id", "node"), ["node", "part"]).drop("part")


class _Lists:
    """Targets of each node in lists (node, ends, base, by, targets); from targets that are `ends` no edges go on.

    Where there are hubs, lists have a part as well. Edges may repeat, targets do not. Of longs, lists have the lower halves, base being the upper one.
    """

    def __init__(self, edges: DataFrame, hub: int, by: Callable[[Column], Column]):
        pairs = edges.where("source_id is not null and target_id is not null").select(F.col("source_id").alias("node"), "target_id")
        self.by, self.long = by, dict(pairs.dtypes)["target_id"] == "bigint"
        degrees = kept(pairs.groupBy("node").agg(F.count("*").alias("degree")), "graph-degrees")
        many = kept(degrees.where(F.col("degree") > hub).select("node"), "graph-many")
        self.hubs, self.keys = None, ["node"]
        if not many.isEmpty():
            n = pairs.join(many, "node", "left_semi").distinct().groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") > hub)
            self.hubs, self.keys = kept(n.select("node", F.ceil(F.col("degree") / hub).cast("int").alias("parts")), "graph-hubs"), ["node", "part"]
        source, far = degrees.select(F.col("node").alias("target_id"), F.lit(False).alias("ends")), None
        if self.long:
            # where few upper halves occur, targets of another one than any source has are ends, without a look-up
            bases = [r[0] for r in degrees.select(self._base(F.col("node"))).distinct().limit(1_001).collect()]
            near = self._base(F.col("target_id")).isin(bases)
            if len(bases) <= 1_000:
                far, pairs = pairs.where(~near).withColumn("ends", F.lit(True)), pairs.where(near)
        pairs = pairs.join(source, "target_id", "left").withColumn("ends", F.coalesce("ends", F.lit(True)))
        pairs = pairs if far is None else pairs.unionByName(far)
        if self.hubs is not None:
            part = F.coalesce(F.pmod(F.xxhash64("target_id"), F.col("parts")), F.lit(0)).cast("int")
            pairs = pairs.join(self.hubs, "node", "left").withColumn("part", part)
        dealt = pairs.select(*self.keys, "ends", *self.split("target_id"))
        self.lists = kept(dealt.groupBy(*self.keys, "ends", "base", "by").agg(F.collect_set("low").alias("targets")), "graph-lists")

    def _base(self, node: Column) -> Column:
        return F.shiftright(node, 32) if self.long else F.lit(None).cast("long")

    def split(self, node: str) -> list[Column]:
        """base, by and low of a node."""
        base = self._base(F.col(node))
        low = (F.col(node) - F.shiftleft(base, 32) - 2**31).cast("int") if self.long else F.col(node)
        return [base.alias("base"), self.by(F.col(node)).alias("by"), low.alias("low")]

    def whole(self, low: str) -> Column:
        return whole("base", F.col(low)) if self.long else F.col(low)

    def step(self, frontier: DataFrame, lists: DataFrame | None = None) -> DataFrame:
        """The frontier's rows with each list of their node, or with those given alone."""
        if self.hubs is not None:
            frontier = frontier.join(self.hubs, "node", "left")
            frontier = frontier.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return frontier.join(self.lists if lists is None else lists, self.keys).drop(*self.keys, "ends")


def whole(base: str, low: Column) -> Column:
    """The long whose upper half is base, and whose lower one is low in a list."""
    return F.shiftleft(base, 32) + low.cast("long") + 2**31


def reached(edges: DataFrame, seeds: DataFrame, hops: int, kinds: list[str] | None = None, hub: int = HUB, by: Callable[[Column], Column] = lambda node: F.lit(0), crowd: int = CROWD) -> DataFrame:
    """(seed, base, by, distance, nodes): what `reach` finds, in lists; each node is in one list, that of its least distance.

    A seed has one or more lists for each distance and each value of `by`, a function of nodes. `whole` puts nodes that are longs together.

    Semi-naive: a round expands only what the one before found first, and drops what earlier rounds know; of the nodes without
    edges it keeps nothing, as no round asks for them. They, and all nodes of the last hop, are found in the end, by one join of all rounds
    with the lists of targets, which pass one shuffle as they are and meet as arrays. Seeds with over `crowd` nodes in the rounds
    may end at any number of nodes, so theirs are rows instead, dealt by seed and node.
    """
    known = _Lists(edges if kinds is None else edges.where(F.col("relationship_type").isin(kinds)), hub, by)
    type_ = "long" if known.long else dict(edges.dtypes)["target_id"]
    start = seeds.select(F.col("seed"), F.col("seed").cast(type_).alias("node")).distinct()
    rounds = [kept(start.withColumn("distance", F.lit(0)), "graph-reach")]
    for hop in range(1, hops):
        on = known.step(rounds[-1].drop("distance"), known.lists.where("not ends")).withColumn("low", F.explode("targets"))
        on = on.select("seed", known.whole("low").alias("node"), F.lit(hop).alias("distance"))
        least = reduce(DataFrame.unionByName, rounds, on).groupBy("seed", "node").agg(F.min("distance").alias("distance"))
        new = kept(least.where(F.col("distance") == hop), "graph-reach")
        if new.isEmpty():
            break
        rounds.append(new)
    every = reduce(DataFrame.unionByName, rounds)
    lists = known.step(every.where(F.col("distance") < hops)).select("seed", "base", "by", (F.col("distance") + 1).alias("distance"), "targets")
    lists = lists.unionByName(rounds[0].select("seed", *known.split("node"), "distance").withColumn("targets", F.array("low")).drop("low"))
    crowded = kept(every.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("seed"), "graph-crowded")
    if crowded.isEmpty():
        return _met(lists, hops)
    each = lists.join(crowded, "seed", "left_semi").withColumn("low", F.explode("targets"))
    each = each.groupBy("seed", "base", "by", "low").agg(F.min("distance").alias("distance"))
    return _met(lists.join(crowded, "seed", "left_anti"), hops).unionByName(each.select("seed", "base", "by", "distance", F.array("low").alias("nodes")))


def _met(lists: DataFrame, hops: int) -> DataFrame:
    """(seed, base, by, distance, nodes) of (seed, base, by, distance, targets): each node once, at its least distance."""
    at = [F.collect_list(F.when(F.col("distance") == hop, F.col("targets"))).alias(f"at{hop}") for hop in range(hops + 1)]
    met = lists.repartition("seed").groupBy("seed", "base", "by").agg(*at)
    met = met.select("seed", "base", "by", *(F.flatten(f"at{hop}").alias(f"at{hop}") for hop in range(hops + 1)))
    new = [F.array_except(f"at{hop}", F.concat(*(f"at{h}" for h in range(hop)))) if hop else F.array_distinct("at0") for hop in range(hops + 1)]
    each = met.select("seed", "base", "by", F.posexplode(F.array(*new)).alias("distance", "nodes"))
    return each.where(F.size("nodes") > 0)


def reach(edges: DataFrame, seeds: DataFrame, hops: int, kinds: list[str] | None = None, hub: int = HUB, crowd: int = CROWD) -> DataFrame:
    """(seed, node, distance): all nodes that a walk of at most `hops` edges of these kinds reaches from each seed, itself at 0.

    Edges with a null end count as none; seeds without edges reach themselves. `reached` has them in lists.
    """
    found = reached(edges, seeds, hops, kinds, hub, crowd=crowd).select("seed", "base", F.explode("nodes").alias("node"), "distance")
    return found.select("seed", (whole("base", F.col("node")) if dict(edges.dtypes)["target_id"] == "bigint" else F.col("node")).alias("node"), "distance")


def chains(edges: DataFrame, seeds: DataFrame, hops: int, kinds: list[str] | None = None, hub: int = HUB) -> DataFrame:
    """(seed, node, hops, path): every path of one to `hops` edges from each seed that meets no node twice, as an array of its nodes."""
    known = _Edges(edges if kinds is None else edges.where(F.col("relationship_type").isin(kinds)), hub)
    frontier = seeds.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path")).distinct()
    rounds = []
    for hop in range(1, hops + 1):
        found = known.step(frontier).where(~F.array_contains("path", F.col("target_id")))
        found = found.select("seed", F.col("target_id").alias("node"), F.lit(hop).alias("hops"), F.concat("path", F.array("target_id")).alias("path"))
        rounds.append(kept(found, "graph-chains"))
        frontier = rounds[-1].select("seed", "node", "path")
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, rounds)


def contradictions(edges: DataFrame, against: str = "contradicts", support: str = "supports") -> DataFrame:
    """(target_id, source_id, n_against, n_support): who contradicts what others support, and how many there are of both.

    A row for each contradicting end, not for each pair of ends: a fact with many of both grows by their sum.
    """
    ends = edges.where(F.col("relationship_type").isin(against, support)).select("source_id", "target_id", "relationship_type").distinct()
    n = ends.groupBy("target_id").agg(F.count_if(F.col("relationship_type") == against).alias("n_against"), F.count_if(F.col("relationship_type") == support).alias("n_support"))
    contested = n.where("n_against > 0 and n_support > 0")
    return ends.where(F.col("relationship_type") == against).join(contested, "target_id").select("target_id", "source_id", "n_against", "n_support")


def missing_evidence(nodes: DataFrame, edges: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """(node, kind, lacks): nodes (node, kind) without an outgoing edge of any of the types that their kind wants.

    wanted: for each kind, the relationship types of which one is enough.
    """
    found = []
    for kind, types in wanted.items():
        have = edges.where(F.col("relationship_type").isin(types) & F.col("target_id").isNotNull()).select(F.col("source_id").alias("node"))
        bare = nodes.where(F.col("kind") == kind).join(have, "node", "left_anti")
        found.append(bare.select("node", "kind", F.lit(" or ".join(types)).alias("lacks")))
    return reduce(DataFrame.unionByName, found)
