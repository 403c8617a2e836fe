"""Strongly connected components and bounded reach of large directed graphs.

Edges are (src, dst).  Steps are equi-joins and partial aggregates over the edges that are left, each written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.sources.shared import dropped, written

#: Doublings of one plan: each is one exchange and a running value, so a plan of several has no branch that is computed twice.
DOUBLINGS = 8
#: Edges of a part of a graph that one row may hold.
SMALL = 1 << 14


def _degrees(e: DataFrame) -> DataFrame:
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))


def _tagged(e: DataFrame, degree: DataFrame) -> DataFrame:
    """Edges with whether each end is inside a path (one edge enters it and one leaves), and ``dead``: whether no edge enters the source or none leaves the target."""
    known = degree.select("node", ((F.col("n_in") == 1) & (F.col("n_out") == 1)).alias("inner"), "n_in", "n_out")
    side = lambda c, n: known.select(F.col("node").alias(c), F.col("inner").alias(f"{c}_inner"), (F.col(n) == 0).alias(f"{c}_dead"))
    both = e.join(side("src", "n_in"), "src").join(side("dst", "n_out"), "dst")
    return both.select("src", "dst", "src_inner", "dst_inner", (F.col("src_dead") | F.col("dst_dead")).alias("dead"))


def _doubled(p: DataFrame) -> DataFrame:
    """Pointers (side, node, to, done, least) after each open one has taken over that of the node it points to.

    A row asks under the node it points to and answers under its own; the answer is the first row of a key.
    """
    mine = lambda c, ask: F.struct(F.col(c).alias("key"), F.lit(ask).alias("ask"), "node", "to", "done", "least")
    rows = p.select("side", F.explode(F.when(F.col("done"), F.array(mine("node", 0))).otherwise(F.array(mine("node", 0), mine("to", 1)))).alias("x")).select("side", "x.*")
    under = Window.partitionBy("side", "key").orderBy("ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("a", F.first(F.struct("to", "done", "least")).over(under)).where("ask = 1 or done")
    asked = F.col("ask") == 1
    pick = lambda c: F.when(asked, F.col(f"a.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("side", "node", pick("to"), pick("done"), F.when(asked, F.least("least", "a.least")).otherwise(F.col("least")).alias("least"))


def _paths(tagged: DataFrame, inner: int) -> DataFrame:
    """(node, start, end, ring, least) of the nodes inside paths, by pointer jumping to both ends.

    A path ends at a node that several edges enter or leave.  What has no end after as many steps as there are such nodes lies on a ring of its own;
    ``least`` is then the ring's least node.
    """
    back = tagged.where("dst_inner").select(F.lit("b").alias("side"), F.col("dst").alias("node"), F.col("src").alias("to"), (~F.col("src_inner")).alias("done"), F.col("dst").alias("least"))
    forth = tagged.where("src_inner").select(F.lit("f").alias("side"), F.col("src").alias("node"), F.col("dst").alias("to"), (~F.col("dst_inner")).alias("done"), F.col("src").alias("least"))
    p, steps = written(back.unionByName(forth), "pointers"), 0
    while (1 << steps) < inner:
        further = p
        for _ in range(min(DOUBLINGS, max(1, inner.bit_length() - steps))):
            further, steps = _doubled(further), steps + 1
        p, before = written(further, "pointers"), p
        dropped(before)
        if p.where("not done").isEmpty():
            break
    both = p.groupBy("node").agg(F.max(F.when(F.col("side") == "b", F.col("to"))).alias("start"), F.max(F.when(F.col("side") == "f", F.col("to"))).alias("end"), F.bool_or(~F.col("done")).alias("ring"), F.min("least").alias("least"))
    out = written(both, "paths")
    dropped(p)
    return out


def _least_both_ways(e: DataFrame) -> DataFrame:
    """(node, f, b): the least node that reaches a node, and the least that it reaches, itself included.

    A step takes the least label over the edges and then the label of the label, so a label's way doubles.
    """
    steps = written(e.select(F.explode(F.array(F.struct(F.lit("f").alias("side"), "src", "dst"), F.struct(F.lit("b").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("x")).select("x.*"), "both-ways")
    label = written(steps.select("side", F.col("src").alias("node")).union(steps.select("side", "dst")).distinct().withColumn("label", F.col("node")), "label")
    while True:
        sent = steps.join(label.withColumnRenamed("node", "src"), ["side", "src"]).groupBy("side", F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        near = written(label.join(sent, ["side", "node"], "left").select("side", "node", F.least("label", "new").alias("label"), F.coalesce(F.col("new") < F.col("label"), F.lit(False)).alias("moved")), "label")
        over = near.where("moved").isEmpty()
        dropped(label)
        if over:
            dropped(steps)
            out = written(near.groupBy("node").agg(F.max(F.when(F.col("side") == "f", F.col("label"))).alias("f"), F.max(F.when(F.col("side") == "b", F.col("label"))).alias("b")), "colours")
            dropped(near)
            return out
        jump = near.select("side", F.col("node").alias("label"), F.col("label").alias("further"))
        label = written(near.join(jump, ["side", "label"]).select("side", "node", F.least("label", "further").alias("label")), "label")
        dropped(near)


def _joined_groups(e: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, group) of every node of edges: nodes that any edges join, whatever their direction, have one group; and the tables that it reads.

    Each node points to its least neighbour where that is less than itself, pointers are followed to their ends, and edges go over to the ends: what is
    left joins fewer nodes by more than a third in each turn of random ids, so the turns together cost little more than the first.
    """
    maps, left = [], written(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "joined")
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("x"))
        up = written(ends.groupBy("x.node").agg(F.min("x.to").alias("to")), "up")
        while True:
            # an end is a node that points to itself
            over = up.where("node != to").select("node", F.col("to").alias("mid")).join(up.select(F.col("node").alias("mid"), F.col("to").alias("to")), "mid")
            over = over.select("node", "to", (F.col("mid") != F.col("to")).alias("moved")).unionByName(up.where("node = to").select("node", "to", F.lit(False).alias("moved")))
            over = written(over, "up")
            still = not over.where("moved").isEmpty()
            dropped(up)
            up = over.select("node", "to")
            up._files_of = over._files_of
            if not still:
                break
        at = lambda c, up=up: up.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        moved = left.join(at("a"), "a").join(at("b"), "b").where("a_to != b_to")
        fewer = written(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "joined")
        dropped(left)
        left = fewer
        maps.append(up)
    dropped(left)
    group = maps[0].select("node", F.col("to").alias("group")) if maps else e.select(F.col("src").alias("node"), F.col("src").alias("group"))
    for up in maps[1:]:
        group = group.join(up.select(F.col("node").alias("group"), F.col("to").alias("end")), "group", "left").select("node", F.coalesce("end", "group").alias("group"))
    return group, maps


def _closed(src: list, dst: list) -> dict:
    """Each node's component, the least node of it, by Tarjan's search over one small group's edges."""
    out: dict = {}
    for a, b in zip(src, dst):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    number, low, held, stack, found = {}, {}, set(), [], {}
    for root in out:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack.append(root)
        held.add(root)
        walk = [(root, iter(out[root]))]
        while walk:
            v, onward = walk[-1]
            for w in onward:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    held.add(w)
                    walk.append((w, iter(out[w])))
                    break
                if w in held:
                    low[v] = min(low[v], number[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == number[v]:
                    at = stack.index(v) if len(stack) < 64 else len(stack) - 1 - stack[::-1].index(v)
                    members, stack[at:] = stack[at:], []
                    held.difference_update(members)
                    found.update(dict.fromkeys(members, min(members)))
    return found


def _small_components(e: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the nodes in groups of at most ``most`` edges, each group's edges in one row; and the edges (src, dst) of larger groups.

    No way leaves a group, so a small one is settled where it lies.
    """
    group, maps = _joined_groups(e)
    grouped = written(e.join(group.withColumnRenamed("node", "src"), "src").select("group", "src", "dst"), "grouped")
    dropped(*maps)
    large = grouped.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > most).select("group")
    many = written(grouped.join(large, "group", "left_semi").select("src", "dst"), "edges")
    rows = grouped.join(large, "group", "left_anti").groupBy("group").agg(F.collect_list("src").alias("srcs"), F.collect_list("dst").alias("dsts"))
    schema = T.StructType([T.StructField(c, e.schema["src"].dataType) for c in ("node", "component")])

    def settle(batches):
        for batch in batches:
            nodes, components = [], []
            for src, dst in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _closed(src, dst)
                nodes += found
                components += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(nodes, batch.schema.field(0).type.value_type), pa.array(components, batch.schema.field(0).type.value_type)], ["node", "component"])

    out = written(rows.select("srcs", "dsts").mapInArrow(settle, schema), "small")
    dropped(grouped)
    return out, many


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges; the component is its least node.

    A graph that is not mostly insides of paths is first cut into the parts that no edges join; small parts are settled each by itself (``_small_components``), and those
    of more than SMALL edges go on.  In turns: (1) nodes that no edge enters or none leaves are their own components and go; (2) the insides of paths are replaced by one
    edge, by pointer jumping, so a chain or a ring of n nodes takes log2(n) doublings; what is inside a path belongs to the component of its
    ends where these are one, and to none otherwise; rings are components.  Where that no longer takes away a tenth of the edges, (3) every node gets the least node that reaches
    it and the least that it reaches; where both are one, that names its component; of the rest only edges between nodes with like labels can
    lie within a component.  A graph whose edges lie on long paths with branches takes labels along them; each step of it doubles
    the way of a label where labels follow each other.
    """
    plain = edges.where("src is not null and dst is not null").select("src", "dst")
    e = written(plain.where("src != dst").distinct(), "edges")
    paths, settled, left, parted = [], [], e.count(), False
    while left:
        tagged = written(_tagged(e, _degrees(e)), "tagged")
        dropped(e)
        inner, alive = tagged.agg(F.count_if("src_inner"), F.count_if(~F.col("dead"))).first()
        before = left
        if alive and not parted and 2 * inner < before:
            small, e = _small_components(tagged.where("not dead").select("src", "dst"), SMALL)
            settled.append(small)
            dropped(tagged)
            left, parted = e.count(), True
            continue
        e = tagged.where("not src_inner and not dst_inner and not dead").select("src", "dst")
        if inner:
            p = _paths(tagged, inner)
            settled.append(p.where("ring").select("node", F.col("least").alias("component")))
            paths.append(p)
            e = e.unionByName(p.where("not ring and start != end").select(F.col("start").alias("src"), F.col("end").alias("dst"))).distinct()
        e = written(e, "edges")
        dropped(tagged)
        left = e.count()
        if left > 0.9 * before:
            colour = _least_both_ways(e)
            settled.append(colour.where("f = b").select("node", F.col("f").alias("component")))
            side = lambda c, colour=colour: colour.where("f != b").select(F.col("node").alias(c), F.col("f").alias(f"{c}_f"), F.col("b").alias(f"{c}_b"))
            like = e.join(side("src"), "src").join(side("dst"), "dst").where("src_f = dst_f and src_b = dst_b").select("src", "dst")
            e, old = written(like, "edges"), e
            dropped(old)
            left = e.count()
    kind = edges.schema["src"].dataType.simpleString()
    label = reduce(DataFrame.unionByName, settled) if settled else edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    for p in reversed(paths):
        ends = p.where("not ring").select("node", "start", "end")
        for c in ("start", "end"):
            ends = ends.join(label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")), c, "left").withColumn(f"{c}_of", F.coalesce(f"{c}_of", c))
        inside = ends.where("start_of = end_of").select("node", F.col("start_of").alias("component"))
        label = written(label.unionByName(inside), "label")
    # the node that names a component belongs to it, also where all its edges went with a path that begins and ends there
    label = label.unionByName(label.select(F.col("component").alias("node"), "component")).distinct()
    named = label.join(label.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component"))
    every = plain.select(F.col("src").alias("node")).union(plain.select("dst")).distinct()
    out = written(every.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
    dropped(e, *paths)
    return out


def cyclic_nodes(edges: DataFrame, skip_loops: bool = True) -> DataFrame:
    """Nodes that reach themselves: those of components of two nodes or more, and loops if asked."""
    c = strong_components(edges)
    several = c.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    found = c.join(several, "component", "left_semi").select("node")
    return found if skip_loops else found.union(edges.where("src = dst").select("src")).distinct()


def reached_by(edges: DataFrame, k: int = 17) -> DataFrame:
    """(node, ids, n): the k least nodes that reach a node, itself among them, and how many these are.

    The k least of a union come from the k least of its parts, so these sets are exact however ways meet; n < k is the full count.  A
    step is linear in the edges whose source's set has changed, and passes on what is new alone; there are as many steps as hops of the longest way that carries one of the ids.
    """
    steps = written(edges.where("src != dst").select("src", "dst").distinct(), "steps")
    ids = steps.select(F.col("src").alias("node")).union(steps.select("dst")).distinct().select("node", F.col("node").alias("id"))
    ids = written(ids, "ids")
    fresh = ids
    first = Window.partitionBy("node").orderBy("id")
    while True:
        sent = fresh.select(F.col("node").alias("src"), "id").join(steps, "src").select(F.col("dst").alias("node"), "id").distinct()
        both = ids.withColumn("old", F.lit(True)).unionByName(sent.withColumn("old", F.lit(False))).groupBy("node", "id").agg(F.bool_or("old").alias("old"))
        both = written(both.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).select("node", "id", "old"), "ids")
        dropped(ids)
        ids, fresh = both.select("node", "id"), both.where("not old").select("node", "id")
        ids._files_of = both._files_of
        if fresh.isEmpty():
            break
    return ids.groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def counted_reach(edges: DataFrame, k: int = 17) -> DataFrame:
    """(node, n): how many nodes reach a node, itself among them, at most k; nodes that no edge enters are left out.

    By doubling: a row has the nodes nearer than d hops and those at exactly d.  A node at up to 2d hops lies within d hops of one at exactly d, so a
    step asks these alone.  A node that k or more reach is full and asks no more; the others have fewer than k levels, so log2(k) steps are
    enough and a row never holds k nodes.
    """
    kind = edges.schema["src"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    first = Window.partitionBy("dst").orderBy("src")
    # k - 1 others make a node full, so of a hub's edges no more are kept
    steps = edges.where("src != dst").select("src", "dst").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") < k)

    def bounded(df: DataFrame) -> DataFrame:
        full = F.col("full") | (F.size("near") + F.size("far") >= k)
        return df.select("node", full.alias("full"), F.when(full, none).otherwise(F.col("near")).alias("near"), F.when(full, none).otherwise(F.col("far")).alias("far"))

    rows = steps.groupBy(F.col("dst").alias("node")).agg(F.collect_list("src").alias("far"))
    rows = written(bounded(rows.select("node", F.lit(False).alias("full"), F.array("node").alias("near"), "far")), "reach")
    d = 1
    while d < k - 1 and not rows.where("size(far) > 0").isEmpty():
        asked = rows.where("size(far) > 0").select(F.col("node").alias("for"), F.explode("far").alias("node"))
        told = asked.join(rows, "node", "left").select(
            F.col("for").alias("node"), F.coalesce("full", F.lit(False)).alias("full"), F.coalesce("near", F.array("node")).alias("near"), F.coalesce("far", none).alias("far")
        )
        own = rows.where("size(far) > 0").select("node", "full", "near", none.alias("far"))
        met = own.unionByName(told).groupBy("node").agg(F.bool_or("full").alias("full"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.array_distinct(F.flatten(F.collect_list("far"))).alias("far"))
        further = bounded(met.withColumn("far", F.array_except("far", "near"))).unionByName(rows.where("size(far) = 0"))
        rows, before = written(further, "reach"), rows
        dropped(before)
        d *= 2
    return rows.select("node", F.when(F.col("full"), k).otherwise(F.size("near") + F.size("far")).cast("long").alias("n"))


def risk_of(edges: DataFrame, nodes: DataFrame, levels: tuple = ((15, "critical"), (5, "high"), (0, "medium")), none: str = "low") -> DataFrame:
    """(node, risk) of the nodes by how many others reach them, without the pairs of the closure: one more id than the highest level asks for is enough."""
    n = F.coalesce(F.col("n"), F.lit(1)) - 1
    risk = F.lit(none)
    for least, name in sorted(levels):
        risk = F.when(n > least, name).otherwise(risk)
    return nodes.select("node").join(counted_reach(edges, max(l for l, _ in levels) + 2), "node", "left").select("node", risk.alias("risk"))
