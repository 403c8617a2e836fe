"""Graph, coupling and resolution queries over the trade graph of nations and the keys of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import audit as A
from lodestrata.operators import graph as G
from lodestrata.operators import resolve as R
from lodestrata.operators import spans as S
from lodestrata.plans.adapters import TRADE, query, table, trade_edges


_START = "'NATION_0'"


def _reach(seed: str, back: bool, most: int) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"""reach AS (SELECT {seed} AS node, 0 AS hops UNION SELECT e.{b}, r.hops + 1 FROM reach r JOIN trade e ON e.{a} = r.node WHERE r.hops < {most})"""


def _seed(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@query(f"WITH RECURSIVE {TRADE}, {_reach(_START, True, 25)} SELECT node, min(hops) AS hops FROM reach GROUP BY node HAVING min(hops) > 0")
def impact_bfs(spark, sf_dir):
    return G.impact(trade_edges(spark, sf_dir), "NATION_0").select("node", "hops")


@query(f"""WITH RECURSIVE {TRADE}, {_reach(_START, True, 25)}, d AS (SELECT node, min(hops) AS hops FROM reach GROUP BY node)
    SELECT d.node, min(e.dst) AS parent FROM d JOIN trade e ON e.src = d.node JOIN d p ON p.node = e.dst AND p.hops = d.hops - 1 GROUP BY d.node""")
def impact_parents(spark, sf_dir):
    return G.impact(trade_edges(spark, sf_dir), "NATION_0").select("node", "parent")


@query(f"""WITH RECURSIVE {TRADE}, reach AS (SELECT unnest(['NATION_0', 'NATION_7', 'NATION_12']) AS node, 0 AS hops UNION SELECT e.src, r.hops + 1 FROM reach r JOIN trade e ON e.dst = r.node WHERE r.hops < 3)
    SELECT node, min(hops) AS hops FROM reach GROUP BY node""")
def blast_radius_multi(spark, sf_dir):
    return G.bfs(trade_edges(spark, sf_dir), _seed(spark, "NATION_0", "NATION_7", "NATION_12"), 3, backwards=True).select("node", "hops")


@query(f"""WITH RECURSIVE {TRADE}, pairs AS (SELECT src, dst FROM trade UNION SELECT p.src, e.dst FROM pairs p JOIN trade e ON e.src = p.dst),
    n AS (SELECT n_name AS node, count(src) AS impacted FROM nation LEFT JOIN pairs ON dst = n_name AND src <> n_name GROUP BY n_name)
    SELECT node, impacted, CASE WHEN impacted > 15 THEN 'critical' WHEN impacted > 5 THEN 'high' WHEN impacted > 0 THEN 'medium' ELSE 'low' END AS risk FROM n""")
def risk_level(spark, sf_dir):
    asked = table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"))
    n = G.impacted_counts(trade_edges(spark, sf_dir), asked)
    return n.withColumn("risk", G.risk_level(F.col("impacted")))


@query(f"WITH {TRADE} SELECT node, count(DISTINCT o) AS n_out, count(DISTINCT i) AS n_in FROM (SELECT src AS node, dst AS o, NULL AS i FROM trade UNION ALL SELECT dst, NULL, src FROM trade) GROUP BY node")
def adjacency(spark, sf_dir):
    return G.adjacency(trade_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {TRADE}, both_ways AS (SELECT src AS a, dst AS b FROM trade UNION SELECT dst, src FROM trade),
    reach AS (SELECT 'NATION_3' AS node, 0 AS hops UNION SELECT b, hops + 1 FROM reach JOIN both_ways ON a = node WHERE hops < 2)
    SELECT src, dst FROM trade WHERE src IN (SELECT node FROM reach) AND dst IN (SELECT node FROM reach)""")
def ego_graph_k2(spark, sf_dir):
    return G.ego_graph(trade_edges(spark, sf_dir), _seed(spark, "NATION_3"), 2)


@query(f"WITH RECURSIVE {TRADE}, pairs AS (SELECT src, dst FROM trade UNION SELECT p.src, e.dst FROM pairs p JOIN trade e ON e.src = p.dst) SELECT src AS node FROM pairs WHERE src = dst")
def nodes_on_cycles(spark, sf_dir):
    return G.nodes_on_cycles(trade_edges(spark, sf_dir))


@query()
def cycle_list(spark, sf_dir):
    return G.cycle_list(trade_edges(spark, sf_dir)).select("cycle", F.array_join("nodes", ">").alias("nodes"), "length")


_TREE = "(SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region)"


def _tree(spark, sf_dir):
    n, c, r = (table(spark, sf_dir, t) for t in ("nation", "customer", "region"))
    named = lambda df, p, key, q, up: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("child"), (F.concat(F.lit(q), F.col(up).cast("string")) if up else F.lit(q)).alias("parent"))
    return named(n, "n", "n_nationkey", "r", "n_regionkey").unionByName(named(c, "c", "c_custkey", "n", "c_nationkey")).unionByName(named(r, "r", "r_regionkey", "root", None))


@query(f"WITH RECURSIVE up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM {_TREE} UNION SELECT u.node, t.parent, u.depth + 1 FROM up u JOIN {_TREE} t ON t.child = u.ancestor) SELECT node, ancestor, min(depth) AS depth FROM up GROUP BY node, ancestor")
def ancestor_closure(spark, sf_dir):
    return G.ancestors(_tree(spark, sf_dir))


@query("""WITH e AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT DISTINCT 'n' || c_nationkey AS src, dst, 'buys' AS type FROM e JOIN customer ON 'c' || c_custkey = src""")
def bubble_up_edges(spark, sf_dir):
    o, li, s = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    edges = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("buys").alias("type")).distinct()
    tree = _tree(spark, sf_dir).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    shown = tree.where("dst like 'n%' or dst like 'r%'").select(F.col("dst").alias("node")).unionByName(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node")))
    return G.bubbled_edges(edges, tree, shown)


_LAYERED = """layered AS (SELECT n_name AS node, CASE n_regionkey WHEN 0 THEN 'domain' WHEN 1 THEN 'data' WHEN 2 THEN 'presentation' WHEN 3 THEN 'core' ELSE 'other' END AS layer FROM nation)"""
_COUPLED = f"""{TRADE}, {_LAYERED}, counts AS (SELECT node, layer, (SELECT count(DISTINCT src) FROM trade WHERE dst = node) AS ca, (SELECT count(DISTINCT dst) FROM trade WHERE src = node) AS ce FROM layered),
    coupled AS (SELECT node, layer, ca, ce, CASE WHEN ca + ce > 0 THEN round(ce / (ca + ce), 3) ELSE 0 END AS instability FROM counts)"""


def _layered(spark, sf_dir):
    k = F.col("n_regionkey")
    layer = F.when(k == 0, "domain").when(k == 1, "data").when(k == 2, "presentation").when(k == 3, "core").otherwise("other")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"), layer.alias("layer"))


def _layered_edges(spark, sf_dir):
    n = _layered(spark, sf_dir)
    a, b = n.select(F.col("node").alias("src"), F.col("layer").alias("src_layer")), n.select(F.col("node").alias("dst"), F.col("layer").alias("dst_layer"))
    return trade_edges(spark, sf_dir).join(a, "src").join(b, "dst")


_LAYER_EDGES = f"{TRADE}, {_LAYERED}, edges AS (SELECT src, dst, a.layer AS src_layer, b.layer AS dst_layer FROM trade JOIN layered a ON a.node = src JOIN layered b ON b.node = dst)"


@query(f"WITH {_COUPLED} SELECT * FROM coupled")
def coupling_instability(spark, sf_dir):
    return G.coupling(trade_edges(spark, sf_dir), _layered(spark, sf_dir))


@query(f"WITH {_COUPLED} SELECT layer, count(*) AS files, round(avg(instability), 3) AS instability FROM coupled GROUP BY layer")
def layer_report(spark, sf_dir):
    return A.layer_report(_layered(spark, sf_dir), trade_edges(spark, sf_dir), "ts")


@query(f"WITH {_LAYERED} SELECT layer, count(*) AS n FROM layered GROUP BY layer")
def layer_counts(spark, sf_dir):
    return A.layer_report(_layered(spark, sf_dir), trade_edges(spark, sf_dir), "ts").select("layer", F.col("files").alias("n"))


@query(f"WITH {_LAYER_EDGES} SELECT src, dst, src_layer, dst_layer FROM edges WHERE (src_layer = 'domain' AND dst_layer IN ('data', 'presentation')) OR (src_layer = 'data' AND dst_layer = 'presentation')")
def layer_violations(spark, sf_dir):
    return A.layer_violations(_layered_edges(spark, sf_dir))


@query(f"""WITH {_LAYER_EDGES} SELECT rule, src, dst FROM edges JOIN (VALUES ('Domain Purity', 'domain', ['data', 'presentation']), ('Data Independence', 'data', ['presentation']), ('Core Isolation', 'core', ['presentation', 'data'])) r(rule, layer, forbidden)
    ON src_layer = layer AND list_contains(forbidden, dst_layer)""")
def rule_violations(spark, sf_dir):
    return A.rule_violations(_layered_edges(spark, sf_dir))


@query("""WITH asked AS (SELECT 'src/nation' || n_nationkey || '.ts' AS path, './region' || n_regionkey AS spec FROM nation UNION ALL SELECT 'src/nation' || n_nationkey || '.ts', '../lib/../src/nation' || (n_nationkey + 1) FROM nation UNION ALL SELECT 'src/nation' || n_nationkey || '.ts', 'left-pad' FROM nation),
    f AS (SELECT 'src/region' || r_regionkey || (CASE WHEN r_regionkey % 2 = 0 THEN '.tsx' ELSE '/index.ts' END) AS path FROM region UNION ALL SELECT 'src/nation' || n_nationkey || '.ts' FROM nation),
    c AS (SELECT path, spec, CASE WHEN spec LIKE './%' THEN 'src/' || spec[3:] WHEN spec LIKE '../%' THEN 'src/' || spec[15:] END AS base FROM asked),
    t AS (SELECT c.path, c.spec, f.path AS target, row_number() OVER (PARTITION BY c.path, c.spec ORDER BY s.ord) AS r FROM c CROSS JOIN (VALUES (1, ''), (2, '.ts'), (3, '.tsx'), (4, '.js'), (5, '/index.ts')) s(ord, suffix) JOIN f ON f.path = base || suffix)
    SELECT asked.path, asked.spec, target FROM asked LEFT JOIN t ON t.path = asked.path AND t.spec = asked.spec AND r = 1""")
def import_resolve_candidates(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    own = F.concat(F.lit("src/nation"), F.col("n_nationkey").cast("string"), F.lit(".ts"))
    specs = F.array(F.concat(F.lit("./region"), F.col("n_regionkey").cast("string")), F.concat(F.lit("../lib/../src/nation"), (F.col("n_nationkey") + 1).cast("string")), F.lit("left-pad"))
    asked = n.select(own.alias("path"), F.explode(specs).alias("spec"))
    files = r.select(F.concat(F.lit("src/region"), F.col("r_regionkey").cast("string"), F.when(F.col("r_regionkey") % 2 == 0, ".tsx").otherwise("/index.ts")).alias("path")).unionByName(n.select(own.alias("path")))
    return R.resolve_imports(asked, files)


@query("""WITH s AS (SELECT o_custkey AS path, 'order' AS kind, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS first, CAST(epoch(o_orderdate) // 86400 AS BIGINT) + 30 + o_orderkey % 40 AS last, o_orderkey AS ord FROM orders),
    q AS (SELECT DISTINCT o_custkey AS path, CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT q.path, q.at, arg_min(CAST(s.ord AS VARCHAR), (s.last - s.first) * 1000000000 + s.ord) AS name, arg_min(s.first, (s.last - s.first) * 1000000000 + s.ord) AS line FROM q JOIN s ON q.path = s.path AND q.at BETWEEN s.first AND s.last GROUP BY q.path, q.at""")
def node_at_cursor(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    day = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 86400)
    s = o.select(F.col("o_custkey").alias("path"), F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("name"), day("o_orderdate").alias("line"), (day("o_orderdate") + 30 + F.col("o_orderkey") % 40).alias("line_end"), F.col("o_orderkey").alias("ord"))
    q = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("path"), day("l_shipdate").alias("at")).distinct()
    return S.node_at(s, q).select("path", "at", "name", "line")
