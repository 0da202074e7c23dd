"""Operators on dependency edges and class trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.functions.matching import is_builtin, namespace_matches, under
from codestrata.operators.hierarchy import climb, number_nodes, on_cycles
from codestrata.operators.rollup import ancestors
from codestrata.session import cut


#: A graph of at most so many edges is solved in one task; a task holds about 200 bytes an edge for it.
LOCAL_EDGES = 1_000_000


def distinct_edges(edges: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """One row per pair of different classes that any edge connects."""
    named = edges.where("src_class IS NOT NULL AND dst_class IS NOT NULL AND src_class <> dst_class")
    return named.select(*keys, "src_class", "dst_class").distinct()


def without_builtins(edges: DataFrame) -> DataFrame:
    """Edges without those to the language's own classes, but with every `extends`."""
    return edges.where(~is_builtin(F.col("dst_class")) | F.col("dep_type").eqNullSafe("extends"))


def class_coupling(edges: DataFrame, framework: Sequence[str] = ()) -> DataFrame:
    """Per project and class: `ce`, `ca` (distinct targets, sources), `cbo` (distinct classes on either side),
    `instability` ce/(ca+ce), `ce_packages`, the distinct top-level namespaces of targets other than its own,
    `ce_framework`, the targets in the namespaces `framework`, and `cbo_app`, the coupled classes outside them."""
    pairs = distinct_edges(edges)
    top = lambda c: F.substring_index(c, "\\", 1)
    out = pairs.select("project", F.col("src_class").alias("class"), F.col("dst_class").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = pairs.select("project", F.col("dst_class").alias("class"), F.col("src_class").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    per_other = out.unionByName(into).groupBy("project", "class", "other").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    packages = F.countDistinct(F.when((F.col("o") == 1) & (top(F.col("other")) != top(F.col("class"))), top(F.col("other"))))
    framed = under(F.col("other"), framework)
    sums = per_other.groupBy("project", "class").agg(F.sum("o").alias("ce"), F.sum("i").alias("ca"), F.count("*").alias("cbo"), packages.alias("ce_packages"), F.count_if((F.col("o") == 1) & framed).alias("ce_framework"), F.count_if(~framed).alias("cbo_app"))
    return sums.withColumn("instability", F.coalesce(F.try_divide(F.col("ce").cast("double"), F.col("ca") + F.col("ce")), F.lit(0.0)))


def namespace_coupling(edges: DataFrame) -> DataFrame:
    """Per project and namespace, over edges that cross its border: `ce` and `ca`, distinct outside classes, `cbo`,
    distinct coupled namespaces, and `instability`. Null namespaces are ''."""
    ns = lambda c: F.coalesce(c, F.lit(""))
    e = edges.where("src_class IS NOT NULL AND dst_class IS NOT NULL").select("project", ns(F.col("src_ns")).alias("s"), ns(F.col("dst_ns")).alias("d"), "src_class", "dst_class").where("s <> d")
    out = e.select("project", F.col("s").alias("namespace"), F.col("d").alias("other_ns"), F.col("dst_class").alias("other"), F.lit(True).alias("out"))
    into = e.select("project", F.col("d").alias("namespace"), F.col("s").alias("other_ns"), F.col("src_class").alias("other"), F.lit(False).alias("out"))
    once = out.unionByName(into).distinct()
    sums = once.groupBy("project", "namespace").agg(
        F.countDistinct(F.when(F.col("out"), F.col("other"))).alias("ce"), F.countDistinct(F.when(~F.col("out"), F.col("other"))).alias("ca"), F.countDistinct("other_ns").alias("cbo")
    )
    return sums.withColumn("instability", F.coalesce(F.try_divide(F.col("ce").cast("double"), F.col("ca") + F.col("ce")), F.lit(0.0)))


def boundary_coupling(edges: DataFrame) -> DataFrame:
    """Per project and namespace, ancestors too: distinct outside classes that its subtree depends on (`ce`) and that
    depend on its subtree (`ca`). An edge crosses a subtree's border if exactly one of its ends is inside."""
    e = edges.where("src_class IS NOT NULL AND dst_class IS NOT NULL").select(
        "project", "src_class", "dst_class", ancestors(F.coalesce("src_ns", F.lit(""))).alias("a"), ancestors(F.coalesce("dst_ns", F.lit(""))).alias("b")
    )
    out = e.select("project", F.explode(F.array_except("a", "b")).alias("namespace"), F.col("dst_class").alias("other"), F.lit(True).alias("out"))
    into = e.select("project", F.explode(F.array_except("b", "a")).alias("namespace"), F.col("src_class").alias("other"), F.lit(False).alias("out"))
    return out.unionByName(into).distinct().groupBy("project", "namespace").agg(F.count_if("out").alias("ce"), F.count_if(~F.col("out")).alias("ca"))


def abstractness(kinds: DataFrame) -> DataFrame:
    """`kinds`: project, namespace, kind (class, abstract, interface, trait, enum). Per namespace `abstractness`:
    (abstract + interface) / (class + abstract + interface + trait), within 0 and 1, 0 if there is none."""
    part, whole = F.count_if(F.col("kind").isin("abstract", "interface")), F.count_if(F.col("kind").isin("class", "abstract", "interface", "trait"))
    return kinds.groupBy("project", "namespace").agg(F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)).alias("abstractness"))


def distance(abstract: Column, unstable: Column) -> Column:
    """From the main sequence: |A + I - 1|."""
    return F.abs(abstract + unstable - 1)


def _rank_of(damping: float, tolerance: float, rounds: int):
    def solve(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        order = pd.Index(nodes["node"])
        n = len(order)
        src, dst = order.get_indexer(links["src"]), order.get_indexer(links["dst"])
        degree = np.bincount(src, minlength=n)
        rank = np.full(n, 1 / n)
        for _ in range(rounds):
            got = np.bincount(dst, weights=rank[src] / degree[src], minlength=n) if len(src) else np.zeros(n)
            new = (1 - damping) / n + damping * (got + rank[degree == 0].sum() / n)
            moved = np.abs(new - rank).sum()
            rank = new
            if moved < tolerance:
                break
        return pd.DataFrame({"project": nodes["project"], "class": nodes["class"], "rank": rank})

    return solve


def class_rank(edges: DataFrame, classes: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """PageRank of each project's classes: `project`, `class`, `rank`; a project's ranks sum to 1.

    Only edges between `classes` (`project`, `class`) count, each pair once, no self-loops; the rank of classes without
    edges out is spread evenly. Each project starts uniformly; it ends when it changed by less than `tolerance` in
    sum, or after `rounds`, whatever other projects do. A project of one class has rank 1. A graph that is counted to have at most `local_edges` edges and
    nodes is solved by project in memory; a larger one by rounds of joins and sums.
    """
    nodes = cut(classes.where("class IS NOT NULL").select("project", "class").distinct().withColumn("node", F.monotonically_increasing_id()))
    a = nodes.select(F.col("project").alias("p1"), F.col("class").alias("c1"), F.col("node").alias("src"))
    b = nodes.select(F.col("project").alias("p2"), F.col("class").alias("c2"), F.col("node").alias("dst"))
    pairs = distinct_edges(edges).join(a, F.col("project").eqNullSafe(F.col("p1")) & (F.col("src_class") == F.col("c1")))
    pairs = pairs.join(b, F.col("project").eqNullSafe(F.col("p2")) & (F.col("dst_class") == F.col("c2"))).select("src", "dst")
    degrees = pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    links = cut(pairs.join(degrees, F.col("src") == F.col("node")).select("src", "dst", "degree"))
    if links.count() <= local_edges and nodes.count() <= local_edges:
        placed = links.join(nodes.select(F.col("node").alias("src"), F.col("project").alias("of")), "src").select("of", "src", "dst")
        names = nodes.select("project", "class", "node")
        return names.groupBy("project").cogroup(placed.groupBy("of")).applyInPandas(_rank_of(damping, tolerance, rounds), f"project {nodes.schema['project'].dataType.simpleString()}, class string, rank double")
    sizes = nodes.groupBy(F.col("project").alias("sp")).agg(F.count("*").alias("n"))
    base = nodes.join(sizes, F.col("project").eqNullSafe(F.col("sp"))).select("node", "project", "n").join(degrees.select("node", F.lit(True).alias("gives")), "node", "left")
    state = cut(base.select("node", "project", "n", F.coalesce("gives", F.lit(False)).alias("gives"), F.try_divide(F.lit(1.0), F.col("n").cast("double")).alias("rank"), F.lit(True).alias("moves")))
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        given = links.join(state.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        loose = state.where("NOT gives").groupBy("project").agg(F.sum("rank").alias("loose"))
        joined = state.join(given, "node", "left").join(loose.withColumnRenamed("project", "lp"), F.col("project").eqNullSafe(F.col("lp")), "left")
        new = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.coalesce("loose", F.lit(0.0)) / F.col("n"))
        new = F.when(F.col("moves"), new).otherwise(F.col("rank"))
        moved = cut(joined.select("node", "project", "n", "gives", new.alias("rank"), F.abs(new - F.col("rank")).alias("by")).coalesce(width))
        moving = cut(moved.groupBy(F.col("project").alias("mp")).agg((F.sum("by") >= tolerance).alias("moves")))
        state = moved.drop("by").join(moving, F.col("project").eqNullSafe(F.col("mp"))).drop("mp")
        if moving.where("moves").isEmpty():
            break
    return nodes.select("node", "class").join(state.select("node", "project", "rank"), "node").select("project", "class", "rank")


def connected_components(pairs: DataFrame) -> DataFrame:
    """`pairs` (`a`, `b`, any order) to `node` and `component`, its smallest node. A pair with a null names one node.

    Labels run along edges and jump to their label's label, so rounds grow with the logarithm of the diameter in
    practice.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    alone = pairs.select(F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL").distinct()
    links = cut(both)
    label = cut(alone.withColumn("component", F.col("node")))
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        near = links.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        hooked = label.join(near, "node", "left").select("node", F.least("component", "least").alias("component"), F.col("component").alias("was"))
        hooked = cut(hooked.coalesce(width))
        over = hooked.select(F.col("node").alias("component"), F.col("component").alias("next"))
        label = cut(hooked.join(over, "component").select("node", F.col("next").alias("component"), F.col("was")).coalesce(width))
        if label.where("component <> was").isEmpty():
            return label.select("node", "component")
        label = label.drop("was")


def _components_of(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strongly connected components of more than one node, by depth-first search without recursion."""
    out: dict[str, list[str]] = {}
    for batch in pairs:
        for s, d in batch[["s", "d"]].itertuples(index=False):
            out.setdefault(s, []).append(d)
            out.setdefault(d, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    path: list[str] = []
    on_path: set[str] = set()
    rows: list[tuple[str, str]] = []
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        path.append(root)
        on_path.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    path.append(nxt)
                    on_path.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on_path:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        m = path.pop()
                        on_path.discard(m)
                        members.append(m)
                        if m == node:
                            break
                    if len(members) > 1:
                        rows += [(m, min(members)) for m in members]
    yield pd.DataFrame(rows, columns=["node", "component"])


def strongly_connected(edges: DataFrame, src: str = "src", dst: str = "dst", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """`node` (a string) and `component` (its smallest member) of all strongly connected components with more than one
    node.

    A graph whose edges are counted to be at most `local_edges` is one task's work. A larger one: nodes without a way in or out among the rest are trimmed first; of what is left, the smallest label that reaches a
    node forward and the smallest that it reaches are propagated, and nodes for which both agree form components;
    then the edges between different labels go and the rest repeats. Rounds depend on the graph's shape.
    """
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    live = cut(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s IS NOT NULL AND d IS NOT NULL AND s <> d").distinct())
    if live.count() <= local_edges:
        return live.coalesce(1).mapInPandas(_components_of, "node string, component string")
    found = None
    while True:
        before = -1
        while (now := live.count()) != before:  # trim
            before = now
            tails, heads = live.select(F.col("s").alias("d")).distinct(), live.select(F.col("d").alias("s")).distinct()
            live = cut(live.join(tails, "d", "left_semi").join(heads, "s", "left_semi").select("s", "d").coalesce(width))
        if now == 0:
            return found if found is not None else live.select(F.col("s").alias("node"), F.col("s").alias("component"))
        forward, backward = _least_label(live, "s", "d", width), _least_label(live, "d", "s", width)
        labels = cut(forward.join(backward.withColumnRenamed("label", "back"), "node"))
        done = cut(labels.where("label = back").select("node", F.col("label").alias("component")))
        found = done if found is None else found.unionByName(done)
        ends = labels.select("node", F.struct("label", "back").alias("key"), (F.col("label") == F.col("back")).alias("over"))
        a = ends.select(F.col("node").alias("s"), F.col("key").alias("ks"), F.col("over").alias("os"))
        b = ends.select(F.col("node").alias("d"), F.col("key").alias("kd"), F.col("over").alias("od"))
        live = cut(live.join(a, "s").join(b, "d").where("ks = kd AND NOT os AND NOT od").select("s", "d").coalesce(width))


def _least_label(live: DataFrame, src: str, dst: str, width: int) -> DataFrame:
    """(`node`, `label`): the smallest node that reaches the node along the edges."""
    nodes = live.select(F.explode(F.array("s", "d")).alias("node")).distinct()
    label = cut(nodes.withColumn("label", F.col("node")))
    while True:
        sent = live.join(label.select(F.col("node").alias(src), "label"), src).groupBy(F.col(dst).alias("node")).agg(F.min("label").alias("least"))
        label = cut(label.join(sent, "node", "left").select("node", F.least("label", "least").alias("label"), (F.col("least") < F.col("label")).alias("fell")).coalesce(width))
        if label.where("fell").isEmpty():
            return label.select("node", "label")


def _cycle_of(group: pd.DataFrame) -> pd.DataFrame:
    start, out = group["component"].iloc[0], {}
    for s, d in group[["s", "d"]].itertuples(index=False):
        out.setdefault(s, []).append(d)
    level, seen = {start: [start]}, {start}
    while level:
        ahead: dict[str, list[str]] = {}
        for node, way in level.items():
            for d in out.get(node, ()):
                if d not in ahead or [*way, d] < ahead[d]:
                    ahead[d] = [*way, d]
        if start in ahead:
            return pd.DataFrame({"component": [start], "cycle": [ahead[start]]})
        level = {d: way for d, way in ahead.items() if d not in seen}
        seen |= set(level)
    return pd.DataFrame({"component": [], "cycle": []})


def shortest_cycles(edges: DataFrame, members: DataFrame, src: str = "src", dst: str = "dst", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Per component of `members` (`node`, `component`): `size`, sorted `members`, and `cycle`, the shortest cycle
    through the smallest member, of several the first in order of names.

    Components whose edges are counted to be at most `local_edges` in all are searched one by one in memory. Else it goes
    breadth first from all components' smallest members at once; each round is a join of the frontier with the edges
    inside components. Only one way to each node is kept, so the frontier never exceeds the nodes.
    """
    m1 = members.select(F.col("node").alias("s"), F.col("component").alias("c1"))
    m2 = members.select(F.col("node").alias("d"), F.col("component").alias("c2"))
    inner = cut(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s <> d").distinct().join(m1, "s").join(m2, "d").where("c1 = c2").select("s", "d", F.col("c1").alias("component")))
    held = members.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members"))
    if inner.count() <= local_edges:
        return held.join(inner.groupBy("component").applyInPandas(_cycle_of, "component string, cycle array<string>"), "component")
    frontier = members.where("node = component").select("component", "node", F.array("node").alias("way"))
    seen, closed, width = frontier.select("component", "node"), None, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_components = members.select("component").distinct()
    while True:
        step = frontier.select("component", F.col("node").alias("s"), "way").join(inner, ["component", "s"]).select("component", F.col("d").alias("node"), F.concat("way", F.array("d")).alias("way"))
        step = cut(step.groupBy("component", "node").agg(F.min("way").alias("way")).coalesce(width))
        back = cut(step.where("node = component").select("component", F.col("way").alias("cycle")))
        closed = back if closed is None else closed.unionByName(back)
        open_components = cut(open_components.join(back.select("component"), "component", "left_anti").coalesce(width))
        frontier = step.join(seen, ["component", "node"], "left_anti").join(open_components, "component", "left_semi")
        frontier = cut(frontier.coalesce(width))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier.select("component", "node")).coalesce(width))
    return held.join(closed, "component")


def children(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """NOC: per project and class of `classes` the number of distinct classes that extend it directly, 0 if none does."""
    kids = edges.where("dep_type = 'extends' AND src_class <> dst_class").select("project", "dst_class", "src_class").distinct()
    counts = kids.groupBy(F.col("project").alias("kp"), F.col("dst_class").alias("kc")).agg(F.count("*").alias("n"))
    mine = classes.select("project", "class").distinct()
    return mine.join(counts, F.col("project").eqNullSafe(F.col("kp")) & (F.col("class") == F.col("kc")), "left").select("project", "class", F.coalesce("n", F.lit(0)).alias("noc"))


def inheritance_depth(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """DIT: per project and class of `classes` the number of `extends` steps up to the last known parent, 0 without one.

    Of several parents the first by name counts. A class of the language ends the way, whatever it extends itself; so does
    a parent without a parent of its own, declared or not. A cycle is cut before its first member by name: the class that
    extends it has 1, and so on around the cycle; what leads into the cycle goes on counting from there.
    """
    links = edges.where("dep_type = 'extends' AND src_class IS NOT NULL AND dst_class IS NOT NULL").groupBy("project", "src_class").agg(F.min("dst_class").alias("parent"))
    parent = F.when(is_builtin(F.col("parent")), F.concat(F.lit("\0"), "parent")).otherwise(F.col("parent"))  # not the class of that name here
    nodes = number_nodes(links.select(F.col("project").alias("scope"), F.col("src_class").alias("id"), parent.alias("parent")))
    reached, lost = climb(nodes.select("v", "p"))
    circle = cut(nodes.join(on_cycles(lost), "v").select("v", "p", "id"))
    names = connected_components(circle.select(F.col("v").alias("a"), F.col("p").alias("b")))
    first = circle.join(names.withColumnRenamed("node", "v"), "v").groupBy("component").agg(F.min(F.struct("id", "v")).alias("m")).select(F.col("m.v").alias("p"))
    broken = circle.join(first, "p").select("v", F.lit(True).alias("broken"))  # on the cycle and just before its first member
    rest = nodes.select("v", "p").join(lost.select("v"), "v").join(broken, "v", "left")
    unwound, _ = climb(rest.select("v", F.when(F.col("broken").isNull(), F.col("p")).alias("p")))
    depths = reached.select("v", F.col("steps").alias("dit")).unionByName(unwound.select("v", (F.col("steps") + 1).alias("dit")))
    known = nodes.where("declared").join(depths, "v").select(F.col("scope").alias("kp"), F.col("id").alias("kc"), "dit")
    mine = classes.select("project", "class").distinct()
    return mine.join(known, F.col("project").eqNullSafe(F.col("kp")) & (F.col("class") == F.col("kc")), "left").select("project", "class", F.coalesce("dit", F.lit(0).cast("long")).alias("dit"))


def assign_layers(classes: DataFrame, layers: Sequence[tuple[str, Column]]) -> DataFrame:
    """`classes` with `layer`, the first layer whose condition holds, and `matches`, all of them in order (a class with
    several is shadowed); null and empty if none does."""
    hits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in layers]), lambda x: x.isNotNull())
    return classes.withColumn("matches", hits).withColumn("layer", F.try_element_at("matches", F.lit(1)))


def layer_criteria(*kinds: Sequence[Column], match: str = "any", exclude: Sequence[Sequence[Column]] = (), exclude_match: str = "any") -> Column:
    """Membership of a layer: within one kind of criterion the conditions are OR; `any` kind suffices or `all` declared
    ones must hold; an excluding block vetoes in its own mode."""
    from codestrata.functions.matching import any_of

    def block(blocks: Sequence[Sequence[Column]], mode: str) -> Column:
        parts = [any_of(b) for b in blocks if b]
        if not parts:
            return F.lit(False)
        out = parts[0]
        for p in parts[1:]:
            out = (out | p) if mode == "any" else (out & p)
        return out

    return block(kinds, match) & ~block(exclude, exclude_match)


def layer_violations(edges: DataFrame, assigned: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges from a layer to another that `allowed` (`src_layer`, `dst_layer`, `dep_type` or null for any) doesn't have.

    `assigned`: `project`, `class`, `layer`. Edges within a layer are fine; edges with an end without a layer aren't
    judged. `allowed` is a policy of configuration size.
    """
    layered = assigned.where("layer IS NOT NULL")
    a = layered.select(F.col("project").alias("p1"), F.col("class").alias("c1"), F.col("layer").alias("src_layer"))
    b = layered.select(F.col("project").alias("p2"), F.col("class").alias("c2"), F.col("layer").alias("dst_layer"))
    e = edges.join(a, F.col("project").eqNullSafe(F.col("p1")) & (F.col("src_class") == F.col("c1"))).join(b, F.col("project").eqNullSafe(F.col("p2")) & (F.col("dst_class") == F.col("c2")))
    crossing = e.where("src_layer <> dst_layer").drop("p1", "c1", "p2", "c2")
    ok = allowed.select(F.col("src_layer").alias("al"), F.col("dst_layer").alias("bl"), F.col("dep_type").alias("at"))
    return crossing.join(ok, (F.col("src_layer") == F.col("al")) & (F.col("dst_layer") == F.col("bl")) & (F.col("at").isNull() | (F.col("at") == F.col("dep_type"))), "left_anti")


def layer_diagnostics(assigned: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Per declared layer: `classes` that it has, `matched` ones (also those that an earlier layer took), and `status`:
    empty (nothing matches), shadowed (earlier layers take all of it) or used. `layers` has the size of a policy."""
    spark = assigned.sparkSession
    declared = spark.createDataFrame([(i, n) for i, n in enumerate(layers)], "ordinal int, layer string")
    own = assigned.where("layer IS NOT NULL").groupBy("layer").agg(F.count("*").alias("classes"))
    any_ = assigned.select(F.explode("matches").alias("layer")).groupBy("layer").agg(F.count("*").alias("matched"))
    rows = declared.join(own, "layer", "left").join(any_, "layer", "left").select("ordinal", "layer", F.coalesce("classes", F.lit(0)).alias("classes"), F.coalesce("matched", F.lit(0)).alias("matched"))
    return rows.withColumn("status", F.when(F.col("matched") == 0, "empty").when(F.col("classes") == 0, "shadowed").otherwise("used"))


def reachable(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All (`src`, `dst`) such that a way of one or more edges leads from src to dst; cycles end by themselves.

    The result is as large as it is: use it for hierarchies (parents and interfaces of classes), where ways are short.
    Each round joins the pairs found last with all pairs, so ways double in length: rounds are log2 of the longest.
    """
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    found = new = links
    while not new.isEmpty():
        step = new.join(found.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct()
        new = cut(step.join(found, ["src", "dst"], "left_anti").coalesce(width))
        found = cut(found.unionByName(new).coalesce(width))
    return found


def edge_export(edges: DataFrame) -> DataFrame:
    """Per pair of classes the sorted distinct kinds of its edges and their number."""
    named = edges.where("src_class IS NOT NULL AND dst_class IS NOT NULL")
    return named.groupBy("project", F.col("src_class").alias("from"), F.col("dst_class").alias("to")).agg(F.array_sort(F.collect_set("dep_type")).alias("types"), F.count("*").alias("count"))


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first `n` rows of each key with their `rank`; Spark filters to n per task before the shuffle."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def in_namespaces(edges: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Edges with either end in one of the namespaces, for the export of a part of a graph; all without patterns."""
    if not patterns:
        return edges
    return edges.where(namespace_matches(F.col("src_ns"), patterns) | namespace_matches(F.col("dst_ns"), patterns))


def inspect_layer(classes: DataFrame, layers: Sequence[tuple[str, Column]], name: str) -> DataFrame:
    """What a policy does with each class that layer `name` matches: `class`, `namespace`, `taken` (whether it is the layer
    that the class gets), and `layer`, the one that it gets."""
    assigned = assign_layers(classes, layers)
    return assigned.where(F.array_contains("matches", name)).select("project", "class", "namespace", (F.col("layer") == name).alias("taken"), "layer")
