"""Parent-child rows of unknown depth to full hierarchies, by heavy-path decomposition.

Every step is a join or an aggregate on node numbers; the number of steps grows with the logarithm of the depth. Rounds
run over inner nodes only: a leaf takes what its parent has, in one join at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.session import cut

#: Siblings are numbered within so many buckets a parent, so that one parent's children are never one task's work.
SIBLING_BUCKETS = 1024
#: What a round leaves is held in so many rows a partition, but in no more partitions than a shuffle has.
ROWS_A_PARTITION = 200_000


def climb(links: DataFrame, sums: Sequence[str] = (), sizes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Follow `p` from each `v` to the top, doubling the stride in each round.

    `links` has `v` (unique), `p` (null at a top, else some v), with `sizes` a `weight`, and the long columns `sums`, which
    are added up over the links from v to the top (a top's own count as 0). Returned: (`v`, `top`, `steps`, sums, and with
    `sizes` the `size` of v's subtree, its weights added up) of all v that reach a top, and (`v`, `a`) of those that never
    do because a cycle is ahead. A self-link is a cycle. Rounds: log2 of the greatest depth, plus two.
    """
    top = F.col("p").isNull()
    width = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = [(F.col("weight") if sizes else F.lit(1)).cast("long").alias("size")]
    state = cut(
        links.select(
            "v", F.coalesce("p", "v").alias("a"), top.alias("done"), F.when(top, 0).otherwise(1).cast("long").alias("steps"),
            *[F.when(top, 0).otherwise(F.col(c)).cast("long").alias(c) for c in sums], *size,
        )
    )
    all_rows, open_rows = state.agg(F.count("*"), F.count_if(~F.col("done"))).first()
    width, stride = min(width, all_rows // ROWS_A_PARTITION + 1), 1
    while open_rows:
        now = state
        if sizes:  # v's subtree so far reaches stride - 1 levels down; the subtrees stride levels below add to it
            below = state.where((F.col("steps") == stride) & (F.col("a") != F.col("v"))).groupBy(F.col("a").alias("v")).agg(F.sum("size").alias("more"))
            now = state.join(below, "v", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        ahead = state.select(F.col("v").alias("a"), F.col("a").alias("a2"), F.col("done").alias("done2"), *[F.col(c).alias(f"{c}2") for c in ("steps", *sums)])
        moved = now.where("NOT done").join(ahead, "a").select(
            "v", F.col("a2").alias("a"), F.col("done2").alias("done"), *[(F.col(c) + F.col(f"{c}2")).alias(c) for c in ("steps", *sums)], "size"
        )
        # a union has the partitions of both its sides; without coalesce they would double in each round
        state, before = cut(now.where("done").unionByName(moved).coalesce(width)), open_rows
        open_rows, stride = state.where("NOT done").count(), stride * 2
        if open_rows == before:  # depths have no gaps: if none ends between stride and twice stride, none ends beyond
            break
    reached = state.where("done").select("v", F.col("a").alias("top"), "steps", *sums, *(["size"] if sizes else []))
    return reached, state.where("NOT done").select("v", "a")


def on_cycles(ahead: DataFrame) -> DataFrame:
    """The nodes (`v`) that lie on a cycle, among nodes (`v`, `a`) that all lead into one; `a` is some node ahead of v.

    The image of all nodes under a stride shrinks until the stride exceeds the longest way into a cycle; from then on
    it is the cycles' nodes exactly, for a stride turns each cycle onto itself.
    """
    pairs = cut(ahead)
    width = min(int(ahead.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // ROWS_A_PARTITION + 1)
    left = None
    while True:
        image = pairs.select(F.col("a").alias("v")).distinct()
        now = image.count()
        if now == left or now == 0:
            return image
        left = now
        pairs = cut(pairs.join(pairs.select(F.col("v").alias("a"), F.col("a").alias("a2")), "a").select("v", F.col("a2").alias("a")).coalesce(width))


def number_nodes(given: DataFrame) -> DataFrame:
    """(`v`, `scope`, `id`, `declared`, `p`): every id and parent of `given` once. `v` is a hash of scope and id, `p` that of
    the parent, so no name is ever joined; should two names share a hash, the next seed is taken."""
    for seed in range(64):
        of = lambda c: F.xxhash64(F.lit(seed), F.col("scope"), F.col(c))
        up = F.when(F.col("parent").isNotNull(), of("parent"))
        both = F.array(
            F.struct(of("id").alias("v"), "scope", "id", F.lit(True).alias("declared"), up.alias("p")),
            F.when(F.col("parent").isNotNull(), F.struct(of("parent").alias("v"), "scope", F.col("parent").alias("id"), F.lit(False).alias("declared"), F.lit(None).cast("long").alias("p"))),
        )
        rows = given.select(F.explode(both).alias("r")).where("r IS NOT NULL").select("r.*")
        nodes = cut(rows.groupBy("v", "scope", "id").agg(F.max("declared").alias("declared"), F.max("p").alias("p")))
        if nodes.groupBy("v").count().where("count > 1").isEmpty():
            return nodes
    raise RuntimeError("no seed tells all names apart")


@dataclass
class Forest:
    """A forest made by `decompose`.

    `names`: v, scope, id, declared, p of every node. `inner`: of each node with children v, p, `id`, `cycle`, and in
    trees `size`, `heavy` and `heavy_size` (its heaviest child), `chain`, `place`, `up_chain`, `up_place`, `root_number`,
    `root`, `depth`. Both are written.
    """

    names: DataFrame
    inner: DataFrame

    def _leaves(self, columns: Sequence[str]) -> DataFrame:
        """Nodes without children, with some columns of their parent, named `up_<column>`; nulls without a parent."""
        mine = self.names.join(self.inner.select("v"), "v", "left_anti")
        return mine.join(self.inner.select(F.col("v").alias("p"), *[F.col(c).alias(f"up_{c}") for c in columns]), "p", "left")

    @cached_property
    def nodes(self) -> DataFrame:
        """One row per node: scope, id, declared, has_parent, `root` (an id), `depth`, `size` (itself and its
        descendants), `chain` and `place` (its heavy path, by the number of its head, and the place in it), `number`,
        `root_number` and `cycle`.

        `cycle` is 'on' or 'into' for nodes on a cycle or below one; they have no root, depth, size or chain.
        """
        own = ["root", "root_number", "depth", "size", "chain", "place", "cycle"]
        inner = self.names.join(self.inner.select("v", *own), "v")
        top, lost = F.col("p").isNull(), F.col("up_cycle").isNotNull()
        is_heavy = F.col("up_heavy") == F.col("v")
        tree = lambda c: F.when(~lost | top, c)
        leaves = self._leaves(["root", "root_number", "depth", "chain", "place", "cycle", "heavy"]).select(
            *self.names.columns, F.when(top, F.col("id")).otherwise(F.col("up_root")).alias("root"), F.when(top, F.col("v")).otherwise(F.col("up_root_number")).alias("root_number"),
            F.when(top, F.lit(0)).otherwise(F.col("up_depth") + 1).cast("long").alias("depth"), tree(F.lit(1)).cast("long").alias("size"),
            tree(F.when(is_heavy, F.col("up_chain")).otherwise(F.col("v"))).alias("chain"), tree(F.when(is_heavy, F.col("up_place") + 1).otherwise(0)).cast("long").alias("place"),
            F.when(lost, "into").alias("cycle"),
        )
        return inner.unionByName(leaves).withColumn("has_parent", F.col("p").isNotNull()).withColumnRenamed("v", "number")

    def paths(self) -> DataFrame:
        """`nodes` of the trees with `path`: the ids from the root to the node, put together from chain segments.

        A chain's inner nodes are gathered once, at its head; a node's path is the segments of the chains above it and the
        part of its own chain up to it, a leaf's that of its parent and itself. A path is as long as the node is deep;
        nothing longer is ever gathered.
        """
        trees = self.inner.where("cycle IS NULL")
        chains = trees.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))
        links = trees.where("place = 0").select(F.col("v").alias("chain"), "up_chain", "up_place")
        done = cut(links.where("up_chain IS NULL").select("chain", F.array().cast("array<string>").alias("above")))
        waiting = links.where("up_chain IS NOT NULL")
        rounds = [done]
        while True:  # one round a light edge on a way down: log2 of the number of nodes at most
            seg = rounds[-1].join(chains, "chain").select(F.col("chain").alias("up_chain"), "above", "ids")
            step = cut(waiting.join(seg, "up_chain").select("chain", F.concat("above", F.expr("slice(ids, 1, CAST(up_place + 1 AS INT))")).alias("above")))
            if step.isEmpty():
                break
            rounds.append(step)
        above = rounds[0]
        for more in rounds[1:]:
            above = above.unionByName(more)
        to_inner = trees.select("v", "chain", "place").join(above.join(chains, "chain"), "chain")
        to_inner = to_inner.select("v", F.concat("above", F.expr("slice(ids, 1, CAST(place + 1 AS INT))")).alias("way"))
        mine = self.nodes.where("cycle IS NULL").withColumn("via", F.when(F.col("size") > 1, F.col("number")).otherwise(F.col("p")))
        ways = mine.join(to_inner.withColumnRenamed("v", "via"), "via", "left")
        alone = F.array("id")
        path = F.when(F.col("size") > 1, F.col("way")).when(F.col("way").isNull(), alone).otherwise(F.concat("way", alone))
        return ways.withColumn("path", path).drop("way", "via")

    def intervals(self) -> DataFrame:
        """`nodes` of the trees with `first`: a node's number in its root's order, in which its descendants have the numbers
        first + 1 to first + size - 1. A heavy child comes first, the others behind it by buckets of their numbers."""
        trees = self.inner.where("cycle IS NULL")
        kids = self.nodes.where("cycle IS NULL AND p IS NOT NULL").select(F.col("number").alias("v"), "p", "size")
        light = kids.join(trees.select(F.col("v").alias("p"), "heavy", "heavy_size"), "p").where("v <> heavy").withColumn("bucket", F.pmod("v", F.lit(SIBLING_BUCKETS)))
        per_bucket = light.groupBy("p", "bucket").agg(F.sum("size").alias("held"))
        earlier = Window.partitionBy("p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        inside = Window.partitionBy("p", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        starts = per_bucket.select("p", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
        placed = light.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["p", "bucket"])
        offsets = cut(placed.select("v", (F.lit(1) + F.col("heavy_size") + F.col("before") + F.col("within")).alias("offset")))
        heads = trees.where("place = 0").select("v", "up_chain", "up_place").join(offsets, "v", "left")
        shifts, _ = climb(heads.select("v", F.col("up_chain").alias("p"), (F.col("up_place") + F.col("offset")).alias("shift")), sums=["shift"])
        numbers = cut(trees.select("v", "chain", "place").join(shifts.select(F.col("v").alias("chain"), "shift"), "chain").select("v", (F.col("shift") + F.col("place")).alias("first")))
        mine = self.nodes.where("cycle IS NULL")
        inner = mine.where("size > 1").join(numbers.withColumnRenamed("v", "number"), "number")
        leaves = mine.where("size = 1").join(numbers.select(F.col("v").alias("p"), F.col("first").alias("up_first")), "p", "left").join(offsets.withColumnRenamed("v", "number"), "number", "left")
        # a heavy child follows its parent; a node without a parent is its root's first
        leaves = leaves.withColumn("first", F.coalesce(F.col("up_first") + F.coalesce("offset", F.lit(1)), F.lit(0))).drop("up_first", "offset")
        return inner.unionByName(leaves)

    def descendants(self) -> DataFrame:
        """(scope, id, descendant, below): each node of a tree with each of its descendants, `below` levels down.

        A node's descendants are one interval of its root's numbers; each number is looked up by an equi-join on root
        and number, so the work is the size of the result.
        """
        nodes = self.intervals()
        wanted = nodes.where("size > 1").select("scope", "id", "root_number", F.col("depth").alias("from_depth"), F.explode(F.expr("sequence(first + 1, first + size - 1)")).alias("first"))
        looked = nodes.select("root_number", "first", F.col("id").alias("descendant"), F.col("depth").alias("to_depth"))
        return wanted.join(looked, ["root_number", "first"]).select("scope", "id", "descendant", (F.col("to_depth") - F.col("from_depth")).alias("below"))


def decompose(rows: DataFrame) -> Forest:
    """The forest of `rows` (`scope`, `id`, `parent`), one row per scope and id; ids of different scopes are unrelated.

    A null parent makes a root. A parent without a row of its own becomes a root that is not `declared`. Rows with a
    null id are dropped; a null scope is a scope. Cycles are separated first and come out apart. An empty table gives
    an empty forest. Other columns are ignored. A parent may have any number of children: sizes are sums with partial
    aggregates, siblings are numbered by buckets, and joins on a crowded parent are split at run time (AQE).
    """
    names = number_nodes(rows.where("id IS NOT NULL").select("scope", "id", "parent"))
    links = names.select("v", "p")
    kids = links.where("p IS NOT NULL").groupBy(F.col("p").alias("v")).agg(F.count("*").alias("kids"))
    inner = cut(links.join(kids, "v"))  # every parent is a node
    inner_kids = inner.where("p IS NOT NULL").groupBy(F.col("p").alias("v")).agg(F.count("*").alias("inner_kids"))
    weighed = inner.join(inner_kids, "v", "left").withColumn("weight", 1 + F.col("kids") - F.coalesce("inner_kids", F.lit(0)))

    reached, lost = climb(weighed.select("v", "p", "weight"), sizes=True)
    circle = on_cycles(lost).withColumn("cycle", F.lit("on"))
    cyclic = lost.select("v").join(circle, "v", "left").select("v", F.coalesce("cycle", F.lit("into")).alias("cycle"))

    trees = inner.select("v", "p").join(reached.select("v", "size"), "v")
    best = trees.where("p IS NOT NULL").groupBy("p").agg(F.max(F.struct("size", "v")).alias("best")).select("p", F.col("best.v").alias("heavy"), F.col("best.size").alias("heavy_size"))
    # where all children are leaves, one of them is the heavy one
    only_leaves = trees.select("v").join(best.select(F.col("p").alias("v")), "v", "left_anti").withColumnRenamed("v", "p")
    best_leaf = links.join(only_leaves, "p", "left_semi").groupBy("p").agg(F.max("v").alias("heavy"), F.lit(1).cast("long").alias("heavy_size"))
    heaviest = cut(best.unionByName(best_leaf))
    up = heaviest.select("p", "heavy")
    chain_links = cut(trees.join(up, "p", "left").select("v", "p", "size", F.when(F.col("heavy") == F.col("v"), F.col("p")).alias("hp")))

    chained, _ = climb(chain_links.select("v", F.col("hp").alias("p")))
    chained = cut(chained.select("v", F.col("top").alias("chain"), F.col("steps").alias("place")))
    holder = chained.select(F.col("v").alias("p"), F.col("chain").alias("up_chain"), F.col("place").alias("up_place"))
    heads = cut(chain_links.where("hp IS NULL").join(holder, "p", "left").select("v", "up_chain", "up_place", (F.col("up_place") + 1).alias("levels")))
    placed, _ = climb(heads.select("v", F.col("up_chain").alias("p"), "levels"), sums=["levels"])
    ids = names.select("v", "id")
    per_chain = heads.select("v", "up_chain", "up_place").join(placed.drop("steps"), "v").join(ids.select(F.col("v").alias("top"), F.col("id").alias("root")), "top")
    per_chain = per_chain.withColumnRenamed("v", "chain").withColumnRenamed("top", "root_number")
    shape = chained.join(per_chain, "chain").join(chain_links.select("v", "p", "size"), "v").join(heaviest.select(F.col("p").alias("v"), "heavy", "heavy_size"), "v").join(ids, "v")
    shape = shape.withColumn("depth", F.col("levels") + F.col("place")).drop("levels").withColumn("cycle", F.lit(None).cast("string"))
    return Forest(names, cut(shape.unionByName(inner.select("v", "p").join(cyclic, "v"), allowMissingColumns=True)))
