"""Graph queries over an edge table (src, dst): neighbourhoods, impact, cycles, ancestors, coupling.

Searches advance a whole frontier per step with an equi-join and an anti-join against what has been reached; every
step is written so that the lineage stays short and lost executors cost one step, and is deleted when the next one stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.components import cyclic_nodes
from lodestrata.sources.shared import dropped, written


def bfs(edges: DataFrame, seeds: DataFrame, most: int = 25, backwards: bool = False, both: bool = False) -> DataFrame:
    """(node, hops, parent) of everything reached from the seeds (node) in at most ``most`` steps.

    hops is exact; of several parents at the same distance the least one is named.  Seeds have 0 hops and no parent.
    """
    a, b = ("dst", "src") if backwards else ("src", "dst")
    steps = edges.select(F.col(a).alias("parent"), F.col(b).alias("node"))
    if both:
        steps = steps.unionByName(edges.select(F.col(b).alias("parent"), F.col(a).alias("node")))
    steps = written(steps.distinct())
    start = seeds.select("node").distinct()
    levels = [written(start.select("node", F.lit(0).alias("hops"), F.lit(None).cast(steps.schema["parent"].dataType).alias("parent")))]
    for hop in range(1, most + 1):
        near = steps.join(levels[-1].select(F.col("node").alias("parent")), "parent").groupBy("node").agg(F.min("parent").alias("parent"))
        fresh = near
        for level in levels:  # a node of an earlier level keeps its distance
            fresh = fresh.join(level.select("node"), "node", "left_anti")
        fresh = written(fresh.select("node", F.lit(hop).alias("hops"), "parent"))
        if fresh.isEmpty():
            dropped(fresh)
            break
        levels.append(fresh)
        if len(levels) > 8:  # one table of what is settled, so plans do not grow with the depth
            settled = written(reduce(DataFrame.unionByName, levels[:-1]))
            dropped(*levels[:-1])
            levels = [settled, levels[-1]]
    out = written(reduce(DataFrame.unionByName, levels), "reached")
    dropped(steps, *levels)
    return out


def impact(imports: DataFrame, target: str, entry_points: DataFrame | None = None, most: int = 25) -> DataFrame:
    """Files that depend on a file, by reverse imports (src imports dst): node, hops, parent, entry_points."""
    spark = imports.sparkSession
    found = bfs(imports, spark.createDataFrame([(target,)], "node string"), most, backwards=True).where("hops > 0")
    if entry_points is None:
        return found
    named = entry_points.groupBy("node").agg(F.array_sort(F.collect_set("entry")).alias("entry_points"))
    return found.join(named, "node", "left")


def chains(reached: DataFrame, most: int = 25) -> DataFrame:
    """(node, chain) from the seed to each node along the parents of bfs()."""
    steps = [written(reached.where("hops = 0").select("node", "hops", F.array("node").alias("chain")))]
    for hop in range(1, most + 1):
        near = reached.where(F.col("hops") == hop).join(steps[-1].select(F.col("node").alias("parent"), "chain"), "parent")
        step = written(near.select("node", "hops", F.concat("chain", F.array("node")).alias("chain")))
        steps.append(step)
        if step.isEmpty():
            break
    out = written(reduce(DataFrame.unionByName, steps).select("node", "chain"), "chains")
    dropped(*steps)
    return out


def risk_level(impacted: Column) -> Column:
    return F.when(impacted > 15, "critical").when(impacted > 5, "high").when(impacted > 0, "medium").otherwise("low")


def ego_graph(edges: DataFrame, focus: DataFrame, depth: int = 1) -> DataFrame:
    """Edges between nodes within ``depth`` undirected steps of the focus nodes."""
    near = bfs(edges, focus, depth, both=True).select("node")
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")


def impacted_counts(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, impacted) for the asked nodes (node): how many others reach each, in full.

    One search back from all asked nodes at once, as pairs of an asked node and what reaches it; for a level of risk alone, ``risk_of``
    needs no pairs.
    """
    steps = written(edges.where("src != dst").select("src", "dst").distinct())
    pairs = fresh = written(asked.select("node", F.col("node").alias("src")).distinct())
    while True:
        sent = fresh.select("node", F.col("src").alias("dst")).join(steps, "dst").select("node", "src").distinct()
        before, fresh = fresh, written(sent.join(pairs, ["node", "src"], "left_anti"))
        if fresh.isEmpty():
            break
        grown = written(pairs.unionByName(fresh))
        dropped(pairs, before)
        pairs = grown
    out = written(pairs.groupBy("node").agg((F.count("*") - 1).alias("impacted")), "impacted")
    dropped(pairs, fresh, steps)
    return out


def nodes_on_cycles(edges: DataFrame, skip_loops: bool = True) -> DataFrame:
    """Nodes that reach themselves: those of strongly connected components of two nodes or more, and loops if asked."""
    return cyclic_nodes(edges, skip_loops)


def cycle_list(edges: DataFrame, dialect: str = "ts", most: int = 50, bound: int = 50_000) -> DataFrame:
    """One cycle for each back edge of a depth-first search in node order, of the edges that lie on cycles.

    The list depends on a sequential order, so the cyclic part of the graph is walked on the driver; it must have at most
    ``bound`` edges.  ts drops cycles that are rotations of each other and sorts by length.
    """
    core = nodes_on_cycles(edges, skip_loops=dialect == "ts")
    part = edges.join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct()
    if part.count() > bound:
        raise ValueError(f"more than {bound} edges lie on cycles; ask for nodes_on_cycles")
    adjacent: dict = {}
    for row in part.orderBy("src", "dst").collect():
        if dialect == "rs" or row["src"] != row["dst"]:
            adjacent.setdefault(row["src"], []).append(row["dst"])
    seen, found = set(), []
    for root in sorted(adjacent):
        if root in seen:
            continue
        path, place, todo = [root], {root: 0}, [iter(adjacent[root])]
        seen.add(root)
        while todo:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                del place[path.pop()]
            elif step in place:
                found.append([*path[place[step] :], step])
            elif step not in seen:
                seen.add(step)
                place[step] = len(path)
                path.append(step)
                todo.append(iter(adjacent.get(step, [])))
    if dialect == "ts":
        turned = {}
        for c in found:
            k = c[:-1].index(min(c[:-1]))
            turned.setdefault(tuple(c[k:-1] + c[:k]), c)
        found = sorted(turned.values(), key=len)
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(i, c, len(c) - 1) for i, c in enumerate(found[:most])], f"cycle int, nodes array<{kind}>, length int")


def ancestors(parents: DataFrame, most: int = 64) -> DataFrame:
    """(node, ancestor, depth) of a hierarchy given as (child, parent); least depth of each."""
    step = written(parents.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    out = step
    for depth in range(2, most + 1):
        up = step.join(parents.select(F.col("child").alias("ancestor"), "parent").hint("merge"), "ancestor").select("node", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        last, step = step, written(up.join(out.select("node", "ancestor").hint("merge"), ["node", "ancestor"], "left_anti").where("node != ancestor"))
        if step.isEmpty():
            break
        out, before = written(out.unionByName(step)), out
        dropped(before, last)
    return out


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) by distinct neighbours, from one pass over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("o"), F.lit(None).cast(edges.schema["src"].dataType).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(None).cast(edges.schema["src"].dataType).alias("o"), F.col("src").alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.countDistinct("o").alias("n_out"), F.countDistinct("i").alias("n_in"))


def coupling(edges: DataFrame, nodes: DataFrame, digits: int = 3) -> DataFrame:
    """(node, layer, ca, ce, instability) with instability ce / (ca + ce), 0 for unconnected nodes."""
    counts = adjacency(edges.where("src != dst").distinct())
    ca, ce = F.coalesce("n_in", F.lit(0)), F.coalesce("n_out", F.lit(0))
    ratio = F.when(ca + ce > 0, F.round(ce / (ca + ce), digits)).otherwise(0.0)
    return nodes.join(counts, "node", "left").select("node", "layer", ca.alias("ca"), ce.alias("ce"), ratio.alias("instability"))


def bubbled_edges(edges: DataFrame, contains: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges between visible nodes; a hidden end is replaced by its nearest visible ancestor in ``contains`` (src holds dst)."""
    up = ancestors(contains.select(F.col("dst").alias("child"), F.col("src").alias("parent")))
    shown = visible.select("node").distinct()
    near = up.join(shown.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi").groupBy("node").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("as"))
    place = shown.select("node", F.col("node").alias("as")).unionByName(near.join(shown, "node", "left_anti"))
    s, d = place.select(F.col("node").alias("src"), F.col("as").alias("s")), place.select(F.col("node").alias("dst"), F.col("as").alias("d"))
    return edges.join(s, "src").join(d, "dst").where("s != d").select(F.col("s").alias("src"), F.col("d").alias("dst"), "type").distinct()


def symbol_graph(files: DataFrame, classes: DataFrame, functions: DataFrame, imports: DataFrame, calls: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, type, path, line; the first of an id wins) and edges (src, dst, type) of a parsed corpus.

    imports needs a resolved ``target``; calls are matched to functions by name, methods of the caller's class first (``call_edges`` looks through receivers and
    the hierarchy).
    """
    fid = lambda c: F.concat(F.lit("file:"), F.col(c))
    cid = lambda c: F.concat(F.lit("class:"), F.col(c))
    own = functions.withColumn("id", F.when(F.col("parent_class").isNotNull(), F.concat(F.lit("method:"), F.col("parent_class"), F.lit("."), F.col("name"))).otherwise(F.concat(F.lit("func:"), F.col("name"))))
    nodes = files.select(fid("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("file").alias("type"), "path", F.lit(1).alias("line"))
    nodes = nodes.unionByName(classes.select(cid("name").alias("id"), "name", F.lit("class").alias("type"), "path", "line"))
    nodes = nodes.unionByName(own.select("id", "name", F.when(F.col("parent_class").isNotNull(), "method").otherwise("function").alias("type"), "path", "line"))
    nodes = nodes.groupBy("id").agg(F.min(F.struct("path", "line", "name", "type")).alias("n")).select("id", "n.name", "n.type", "n.path", "n.line")
    empty = F.array().cast("array<string>")
    several = lambda c, kind: classes.select(cid("name").alias("src"), F.explode(F.coalesce(c, empty)).alias("t"), F.lit(kind).alias("type")).select("src", F.concat(F.lit("class:"), "t").alias("dst"), "type")
    edges = [
        classes.select(fid("path").alias("src"), cid("name").alias("dst"), F.lit("contains").alias("type")),
        own.select(F.when(F.col("parent_class").isNotNull(), cid("parent_class")).otherwise(fid("path")).alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("type")),
        imports.where("target is not null").select(fid("path").alias("src"), fid("target").alias("dst"), F.lit("imports").alias("type")),
        classes.where("extends_class is not null").select(cid("name").alias("src"), cid("extends_class").alias("dst"), F.lit("extends").alias("type")),
        several("implements", "implements"), several("mixins", "mixes_in"),
    ]
    if calls is None:
        return nodes, reduce(DataFrame.unionByName, edges)
    caller = F.when(F.col("caller_class").isNotNull(), F.concat(F.lit("method:"), "caller_class", F.lit("."), "caller_function")).otherwise(F.concat(F.lit("func:"), "caller_function"))
    made = calls.where("caller_function is not null").withColumn("src", caller)
    mine = own.where("parent_class is not null").select(F.col("parent_class").alias("caller_class"), "name", F.col("id").alias("m")).distinct()
    free = own.where("parent_class is null").select("name", F.col("id").alias("f")).distinct()
    made = made.join(mine.hint("merge"), ["caller_class", "name"], "left").join(free.hint("merge"), "name", "left").withColumn("dst", F.coalesce("m", "f"))
    edges.append(made.where("dst is not null and dst != src").select("src", "dst", F.lit("calls").alias("type")))
    return nodes, reduce(DataFrame.unionByName, edges)


def hierarchy(classes: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of classes (name, extends_class, implements, mixins) by name; a class is its own ancestor at depth 0."""
    none = F.array().cast("array<string>")
    over = F.array_compact(F.concat(F.array("extends_class"), F.coalesce("mixins", none), F.coalesce("implements", none)))
    above = classes.select(F.col("name").alias("child"), F.explode(F.transform(over, lambda p: F.trim(F.substring_index(p, "<", 1)))).alias("parent")).where("child != parent").distinct()
    own = classes.select(F.col("name").alias("node"), F.col("name").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    return own.unionByName(ancestors(above))


def call_edges(calls: DataFrame, functions: DataFrame, classes: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(src, dst, type) of calls (path, name, receiver, caller_class, caller_function), each to the owner of the method that it reaches.

    A receiver names a class, a mixin or an enum, or is a variable whose name with a capital is a class; a method belongs to the nearest class of the hierarchy
    that has it, of equally near ones the least name.  Without a receiver that names one, the call's own name may be a class, mixin or enum, else the caller's
    class and its ancestors are searched, else it is a function.  ``others``: (name, kind) of mixins and enums.
    """
    kinds = classes.select("name", F.lit("class").alias("kind"))
    kinds = kinds if others is None else kinds.unionByName(others.select("name", "kind"))
    rank = F.array_position(F.array(*map(F.lit, ("class", "mixin", "enum"))), F.col("kind"))
    kinds = kinds.groupBy("name").agg(F.min_by("kind", rank).alias("kind"))
    own = functions.where("parent_class is not null").select(F.col("parent_class").alias("ancestor"), F.col("name").alias("m")).distinct()
    call = written(calls.select("path", "name", "receiver", "caller_class", "caller_function").withColumn("call", F.monotonically_increasing_id()), "calls")
    variable = F.when(~F.col("receiver").isin("this", "super"), F.concat(F.upper(F.substring("receiver", 1, 1)), F.substring("receiver", 2, 1 << 20)))
    call_ = call.withColumn("typed", variable)
    starts = call_.select("call", F.col("name").alias("m"), F.posexplode(F.array("receiver", "typed", "caller_class")).alias("form", "node")).where("node is not null")
    owner = starts.join(hierarchy(classes), "node").join(own, ["ancestor", "m"]).groupBy("call").agg(*[F.min(F.when(F.col("form") == k, F.struct("depth", "ancestor"))).getField("ancestor").alias(f"owner{k}") for k in range(3)])
    for c in ("receiver", "typed", "name"):
        call_ = call_.join(kinds.select(F.col("name").alias(c), F.col("kind").alias(f"{c}_kind")), c, "left")
    call_ = call_.join(owner, "call", "left")
    method = lambda c: F.concat(F.lit("method:"), c, F.lit("."), "name")
    by_receiver = F.when(F.col("receiver_kind") == "class", F.coalesce(method("owner0"), F.concat(F.lit("class:"), "receiver")))
    by_receiver = by_receiver.when(F.col("receiver_kind").isNotNull(), F.concat("receiver_kind", F.lit(":"), "receiver")).when(F.col("typed_kind") == "class", F.coalesce(method("owner1"), method("typed")))
    by_name = F.when(F.col("name_kind").isNotNull(), F.concat("name_kind", F.lit(":"), "name"))
    dst = F.coalesce(by_receiver, by_name, method("owner2"), F.concat(F.lit("func:"), "name"))
    src = F.when(F.col("caller_class").isNotNull() & F.col("caller_function").isNotNull(), F.concat(F.lit("method:"), "caller_class", F.lit("."), "caller_function"))
    src = F.coalesce(src, F.concat(F.lit("func:"), "caller_function"), F.concat(F.lit("class:"), "caller_class"), F.concat(F.lit("file:"), "path"))
    return call_.select(src.alias("src"), dst.alias("dst"), F.lit("calls").alias("type")).where("src != dst").distinct()


def usage_edges(usages: DataFrame) -> DataFrame:
    """(src, dst, type) of uses of classes and variables (kind, name, def_path, used_in) in other files than their own."""
    rows = usages.where(F.col("kind").isin("class", "variable") & (F.col("used_in") != F.col("def_path")))
    return rows.select(F.concat(F.lit("file:"), "used_in").alias("src"), F.concat("kind", F.lit(":"), "name").alias("dst"), F.concat(F.lit("uses_"), "kind").alias("type")).distinct()


def named_entry_points(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, entry) of functions where control enters: main, lifecycle and handler methods, and methods of UI classes.

    node is ``file:Class.member`` or ``file:name``, as calls are resolved to.
    """
    ui = classes.where(F.coalesce("extends_class", F.lit("")).rlike(r"Widget|State|Activity|Fragment|Component|Service|Application")).select(F.col("name").alias("parent_class"), F.lit(True).alias("ui")).distinct()
    hook = F.col("name").isin("build", "initState", "dispose", "onCreate", "onResume", "onStart", "main", "render", "activate") | F.col("name").rlike("^on[A-Z]")
    rows = functions.join(ui, "parent_class", "left").where(hook | (F.col("ui") & F.col("name").isin("call", "run")) | (F.col("parent_class").isNull() & (F.col("name") == "main")))
    node = F.concat("path", F.lit(":"), F.concat_ws(".", "parent_class", "name"))
    return rows.select(node.alias("node"), F.concat_ws(".", "parent_class", "name").alias("entry")).distinct()


def impact_flows(calls: DataFrame, changed: DataFrame, entries: DataFrame, most: int = 25, k: int = 50) -> DataFrame:
    """(entry, hops, flow): calling chains (src calls dst) from entry points down to changed nodes, of at most ``most`` nodes, shortest first, at most k.

    A caller is reached once, by a shortest chain, so each entry point has one flow."""
    reached = bfs(calls, changed, most - 1, backwards=True)
    path = chains(reached, most - 1).join(entries, "node").join(reached.select("node", "hops"), "node")
    return path.select("entry", "hops", F.array_join(F.reverse("chain"), " -> ").alias("flow")).orderBy("hops", "entry", "flow").limit(k)


def all_flows(calls: DataFrame, entries: DataFrame, targets: DataFrame, most: int = 25, k: int = 50, limit: int | None = 50) -> DataFrame:
    """(entry, node, target, hops, flow): every way of at most ``most`` nodes from entry points (node, entry) down to targets (node) that visits no node
    twice, shortest first, then by entry and flow; at most ``limit`` of them.

    Partial ways are grown from the targets back, a level at a time; of the partial ways from one node to one target, of one length, the k least go on (a ranked aggregate that each
    task cuts before the shuffle), so a level has at most k rows for each node and target, and the result is whole wherever no more than k of them meet.
    Levels stop when ``limit`` flows are found.
    """
    steps = written(calls.where("src != dst").select("src", "dst").distinct())
    first = Window.partitionBy("node", "target").orderBy("flow")
    level = written(targets.select("node", F.col("node").alias("target"), F.array("node").alias("way"), F.col("node").cast("string").alias("flow")).distinct())
    levels, found = [level], 0
    for _ in range(1, most):
        if limit is not None:
            found += level.join(entries.select("node", "entry").distinct(), "node").count()
            if found >= limit:
                break
        grown = level.join(steps.withColumnRenamed("dst", "node"), "node").where(~F.array_contains("way", F.col("src")))
        grown = grown.select(F.col("src").alias("node"), "target", F.concat(F.array("src"), "way").alias("way"), F.concat(F.col("src").cast("string"), F.lit(" -> "), "flow").alias("flow"))
        level = written(grown.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r"))
        if level.isEmpty():
            break
        levels.append(level)
    ways = reduce(DataFrame.unionByName, levels).join(entries.select("node", "entry").distinct(), "node")
    ways = ways.select("entry", "node", "target", (F.size("way") - 1).alias("hops"), "flow")
    out = written(ways.orderBy("hops", "entry", "flow").limit(limit) if limit is not None else ways, "flows")
    dropped(steps, *levels)
    return out


def flows_by_file(calls: DataFrame, entries: DataFrame, symbols: DataFrame, changed: DataFrame, most: int = 25, k: int = 50) -> DataFrame:
    """(entry, flow, hops, path) of flows into symbols (node, path) of changed files (path); a flow that several files cause names the first."""
    targets = symbols.join(changed.select("path").distinct(), "path", "left_semi").select("node", "path")
    flows = all_flows(calls, entries, targets.select("node").distinct(), most, k, None)
    return flows.join(targets.withColumnRenamed("node", "target"), "target").groupBy("entry", "flow", "hops").agg(F.min("path").alias("path"))


def forward_flows(calls: DataFrame, entries: DataFrame, targets: DataFrame, most: int = 5) -> DataFrame:
    """(entry, hops, flow): for each entry point (node, entry) the shortest calling chain of at most ``most`` nodes to a target (node).

    Searched from the targets back, all at once: a node's least distance to any target and the next node on the way are what a
    search from each entry would find, without a frontier for every entry.
    """
    reached = bfs(calls, targets, most - 1, backwards=True)
    path = chains(reached, most - 1).join(entries, "node").join(reached.select("node", "hops"), "node")
    return path.select("entry", "hops", F.array_join(F.reverse("chain"), " -> ").alias("flow"))


def folder_groups(nodes: DataFrame) -> DataFrame:
    """Nodes (id, type, path) with ``group``: the folder of a file, else the type."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return nodes.withColumn("group", F.when(F.col("type") == "file", F.when(folder == "", "root").otherwise(folder)).otherwise(F.col("type")))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total_files, total_edges, most_imported (of equals the first)."""
    counts = edges.where("type = 'imports'").groupBy("dst").agg(F.count("*").alias("n"))
    first = counts.agg(F.min_by(F.regexp_replace("dst", "^file:", ""), F.struct(-F.col("n"), F.col("dst"))).alias("most_imported"))
    return nodes.agg(F.count_if(F.col("type") == "file").alias("total_files")).join(edges.agg(F.count("*").alias("total_edges"))).join(first)


def impact_radius(calls: DataFrame, derived: DataFrame, changed: DataFrame, most: int = 2) -> DataFrame:
    """(node, hops) of names that use or derive from changed names: calls (src calls dst), derived (src extends, implements, mixes in or is on dst)."""
    edges = calls.select("src", "dst").unionByName(derived.select("src", "dst"))
    return bfs(edges, changed, most, backwards=True).where("hops > 0").select("node", "hops")


def mermaid(edges: DataFrame, k: int = 500) -> DataFrame:
    """One row: a diagram of at most k edges, in order."""
    ident = lambda c: F.regexp_replace(c, r"\W", "_")
    line = F.concat(F.lit("  "), ident("src"), F.lit('["'), "src", F.lit('"] --> '), ident("dst"), F.lit('["'), "dst", F.lit('"]'))
    rows = edges.select("src", "dst").distinct().orderBy("src", "dst").limit(k).select(line.alias("line"))
    return rows.agg(F.concat(F.lit("graph LR\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("diagram"))
