"""Queries over the second dialect's audits, usage counts, flows, project files, packages, locale files and file events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import audit as A
from lodestrata.operators import graph as G
from lodestrata.operators import l10n as T
from lodestrata.operators import lines as L
from lodestrata.operators import resolve as R
from lodestrata.parse import tables as P
from lodestrata.plans.adapters import TRADE, query, table, trade_edges
from lodestrata.plans.source_queries import _LONG, _PATH, _calls, _classes, _functions, _imports, _sources, _symbols
from lodestrata.sources import files as Fs
from lodestrata.sources import packages as Pk
from lodestrata.sources.shared import written
from lodestrata.streaming import changes as C


def _text(c: str):
    return F.col(c).cast("string")


# ---- warnings: four kinds of lines, in files of which a third are themes
_WARNED = ("Text('Hello'),", "Text('Hello', S.of(context)),", "color: Colors.red, back: Colors.blue,", "go(Color(0xFF00FF00));")
_WHERE = "CASE WHEN event_id % 3 = 0 THEN 'lib/theme/e' ELSE 'lib/e' END || event_id || '.dart'"
_FOUND = f"""(SELECT {_WHERE} AS path, 1 AS line, CASE event_id % 4 WHEN 0 THEN 'hardcoded_text' ELSE 'hardcoded_color' END AS type,
    CASE event_id % 4 WHEN 0 THEN 'Hello' WHEN 2 THEN 'Colors.red' ELSE 'Color(0xFF00FF00)' END AS value FROM events WHERE event_id % 4 = 0 OR event_id % 4 IN (2, 3) AND event_id % 3 <> 0)"""


def _warnings(spark, sf_dir):
    path = F.concat(F.when(F.col("event_id") % 3 == 0, "lib/theme/e").otherwise("lib/e"), _text("event_id"), F.lit(".dart"))
    text = F.get(F.array(*map(F.lit, _WARNED)), (F.col("event_id") % 4).cast("int"))
    return A.hardcoded_values(table(spark, sf_dir, "events").select(path.alias("path"), F.lit(1).alias("line"), text.alias("text")), "ts")


@query(f"SELECT path, line, type, value FROM {_FOUND}")
def hardcoded_values_ts(spark, sf_dir):
    return _warnings(spark, sf_dir)


@query(f"SELECT path, line, type, value FROM {_FOUND} WHERE type = 'hardcoded_color' AND contains(lower(value), 'red') AND contains(lower(path), 'lib/e1')")
def code_warnings_filtered(spark, sf_dir):
    return A.warnings_where(_warnings(spark, sf_dir), "color", "RED", "lib/E1")


@query(f"SELECT path, count(*) AS n, min(type) || '=1' AS by_type FROM {_FOUND} GROUP BY path")
def warnings_by_file(spark, sf_dir):
    return A.warnings_by_file(_warnings(spark, sf_dir))


# ---- trees: an order, its line numbers with the least flag, and the least type of their parts
@query("""WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(p_type) AS type FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber)
    SELECT l_orderkey AS path, 3 AS depth, arg_min(o_orderstatus || ' > ' || flag || ' > ' || type, l_linenumber) AS deepest, min(l_linenumber) AS deepest_line FROM l JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey""")
def widget_deepest_path(spark, sf_dir):
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    node = lambda df, path, number, parent, depth, name: df.select(F.col(path).alias("path"), number.cast("int").alias("node_id"), parent.cast("int").alias("parent_id"), number.cast("int").alias("ord"), F.lit(depth).alias("depth"), F.col(name).alias("name"), (number % 100).cast("int").alias("line"))
    n = F.col("l_linenumber")
    both = li.join(o, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").join(p, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("p_type").alias("p_type"))
    roots = node(o, "o_orderkey", F.lit(0), F.lit(None), 0, "o_orderstatus")
    return A.deepest_paths(roots.unionByName(node(both, "l_orderkey", n, F.lit(0), 1, "l_returnflag")).unionByName(node(both, "l_orderkey", n + 100, n, 2, "p_type")), 2)


# ---- fields, assets and folders
@query(f"SELECT {_PATH} AS path, 'Part' || p_partkey AS parent, 'c' || p_size AS name, 'TextEditingController' AS type, FALSE AS has_release FROM part WHERE p_size % 2 = 1")
def leaking_fields(spark, sf_dir):
    s = _symbols(spark, sf_dir)
    return A.leaking_fields(P.of_kind(s, "property"), P.of_kind(s, "function"), _sources(spark, sf_dir))


_KEY = "CASE WHEN p_partkey >= 1000 THEN 'p' || p_partkey ELSE 'p' || p_partkey || '.png' END"
_UNNAMED = f"(SELECT 'assets/p' || p_partkey || '.png' AS path, p_size AS size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE contains('assets/p' || (2 * b.p_partkey) || '.png', {_KEY.replace('p_partkey', 'a.p_partkey')})))"


def _assets(spark, sf_dir):
    """Pictures of parts, of which the manifest lists the folder."""
    manifest = spark.createDataFrame([("pubspec.yaml", "flutter:\n  assets:\n    - assets/\nname: x\n")], "path string, content string")
    files = _sources(spark, sf_dir).unionByName(manifest)
    found = table(spark, sf_dir, "part").select(F.concat(F.lit("assets/p"), _text("p_partkey"), F.lit(".png")).alias("path"), F.col("p_size").alias("size"))
    return A.declared_assets(found, files), files


@query(f"SELECT path, size FROM {_UNNAMED}")
def unnamed_assets(spark, sf_dir):
    return A.unnamed_assets(*_assets(spark, sf_dir))


@query(f"SELECT (SELECT count(*) FROM part) AS assets, count(*) AS unused, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM {_UNNAMED}")
def asset_report(spark, sf_dir):
    found, files = _assets(spark, sf_dir)
    return A.asset_report(found, A.unnamed_assets(found, files))


_FROM, _TO = ("domain", "core", "presentation", "data"), ("data", "pages", "data/models", "ui", "metadata")


@query(f"""WITH e AS (SELECT 'lib/' || {list(_FROM)}[1 + p_partkey % 4] || '/p' || p_partkey || '.dart' AS src, 'lib/' || {list(_TO)}[1 + p_size % 5] || '/q.dart' AS dst FROM part),
    r AS (SELECT unnest([{{'rule': 'Domain Layer Isolation', 'layer': 'domain', 'forbidden': 'data'}}, {{'rule': 'Domain Layer Isolation', 'layer': 'domain', 'forbidden': 'presentation'}}, {{'rule': 'Domain Layer Isolation', 'layer': 'domain', 'forbidden': 'ui'}},
      {{'rule': 'Core Isolation', 'layer': 'core', 'forbidden': 'pages'}}, {{'rule': 'Clean Presentation', 'layer': 'presentation', 'forbidden': 'data/models'}}], recursive := true))
    SELECT rule, src, dst, forbidden FROM e, r WHERE contains('/' || src || '/', '/' || layer || '/') AND contains('/' || dst || '/', '/' || forbidden || '/')""")
def segment_violations(spark, sf_dir):
    pick = lambda names, c: F.get(F.array(*map(F.lit, names)), c.cast("int"))
    src = F.concat(F.lit("lib/"), pick(_FROM, F.col("p_partkey") % 4), F.lit("/p"), _text("p_partkey"), F.lit(".dart"))
    return A.segment_violations(table(spark, sf_dir, "part").select(src.alias("src"), F.concat(F.lit("lib/"), pick(_TO, F.col("p_size") % 5), F.lit("/q.dart")).alias("dst")))


# ---- uses, flows and graphs
@query(f"""SELECT 'class' AS kind, 'Part' || p_partkey AS name, {_PATH} AS def_path, 0 AS usage_count FROM part
    UNION ALL SELECT 'function', 'run' || p_size, {_PATH}, count(*) OVER (PARTITION BY p_size) - 1 FROM part UNION ALL SELECT 'function', 'helper' || p_size, {_PATH}, count(*) OVER (PARTITION BY p_size) FROM part
    UNION ALL SELECT 'function', 'dispose', {_PATH}, count(*) OVER () FROM part WHERE {_LONG} UNION ALL SELECT 'property', 'c' || p_size, {_PATH}, count(*) OVER (PARTITION BY p_size) - p_size % 2 FROM part""")
def usage_counts(spark, sf_dir):
    return P.usage_counts(_symbols(spark, sf_dir), _sources(spark, sf_dir))


@query(f"SELECT {_PATH.replace('p_partkey', 'a.p_partkey')} AS def_path, {_PATH.replace('p_partkey', 'b.p_partkey')} AS used_in, CASE WHEN a.p_partkey = b.p_partkey THEN 1 ELSE 2 END AS times FROM part a JOIN part b ON a.p_size = 7 AND b.p_size = 7")
def element_users(spark, sf_dir):
    """Only files that hold the name are parsed, and of their symbols only those of that name are written."""
    files, name = _sources(spark, sf_dir), "helper7"
    found = P.parsed(P.naming(files, name)).where(F.col("name") == name)
    return P.users_in(written(found, "named"), files, name, "function")


@query(f"""WITH RECURSIVE {TRADE}, reach AS (SELECT 'NATION_5' AS node, 0 AS hops UNION SELECT e.src, r.hops + 1 FROM reach r JOIN trade e ON e.dst = r.node WHERE r.hops < 4)
    SELECT node AS entry, min(hops) AS hops FROM reach GROUP BY node""")
def forward_flows(spark, sf_dir):
    entries = table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"), F.col("n_name").alias("entry"))
    return G.forward_flows(trade_edges(spark, sf_dir), entries, spark.createDataFrame([("NATION_5",)], "node string")).select("entry", "hops")


def _graph(spark, sf_dir):
    s = _symbols(spark, sf_dir)
    return G.symbol_graph(_sources(spark, sf_dir), _classes(s), _functions(s), _imports(s, spark, sf_dir), _calls(s).where("receiver is null"))


@query(f"""SELECT count(*) AS total_files, CAST(sum(5 + CASE WHEN {_LONG} THEN 1 ELSE 0 END) AS BIGINT) + (SELECT count(*) FROM part WHERE p_partkey % 7 IN (SELECT p_partkey FROM part)) AS total_edges,
    (SELECT 'lib/p' || (p_partkey % 7) || '.dart' AS f FROM part WHERE p_partkey % 7 IN (SELECT p_partkey FROM part) GROUP BY f ORDER BY count(*) DESC, f LIMIT 1) AS most_imported FROM part""")
def graph_stats(spark, sf_dir):
    return G.graph_stats(*_graph(spark, sf_dir))


@query(f"SELECT 'lib' AS \"group\", count(*) AS n FROM part UNION ALL SELECT 'class', count(*) FROM part UNION ALL SELECT 'method', CAST(sum(1 + CASE WHEN {_LONG} THEN 1 ELSE 0 END) AS BIGINT) FROM part UNION ALL SELECT 'function', count(DISTINCT p_size) FROM part")
def graph_groups(spark, sf_dir):
    return G.folder_groups(_graph(spark, sf_dir)[0]).groupBy("group").agg(F.count("*").alias("n"))


@query(f"SELECT path, line, 'helper7' AS name FROM (SELECT {_PATH} AS path, unnest([5, 9]) AS line FROM part WHERE p_size = 7) ORDER BY path, line LIMIT 50")
def direct_search_calls(spark, sf_dir):
    return L.direct_calls(L.lines(Fs.direct_search_files(_sources(spark, sf_dir))), "helper7")


@query(f"SELECT 'helper' || p_size AS name, min({_PATH}) AS def_path FROM part GROUP BY p_size")
def first_definitions(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("helper"), _text("p_size")).alias("name")).distinct()
    return R.first_definition(names, _functions(_symbols(spark, sf_dir))).select("name", "def_path")


# ---- files, packages, locale files and events
_PLACES = ("lib/e%s.dart", "android/app/src/main/e%s.kt", "test/e%s.dart", "src/e%s.ts", "app/e%s.py", "library/e%s.dart")


@query("SELECT CASE event_id % 6 WHEN 0 THEN 'lib/e' || event_id || '.dart' WHEN 1 THEN 'android/app/src/main/e' || event_id || '.kt' ELSE 'src/e' || event_id || '.ts' END AS path FROM events WHERE event_id % 6 IN (0, 1, 3)")
def direct_search_scope(spark, sf_dir):
    path = F.get(F.array(*[F.format_string(p, _text("event_id")) for p in _PLACES]), (F.col("event_id") % 6).cast("int"))
    return Fs.direct_search_files(table(spark, sf_dir, "events").select(path.alias("path")))


@query("""SELECT 'pkg' || p_partkey AS name, '1.' || p_size AS version, 'npm' AS source, 'direct main' AS dependency_type FROM part UNION ALL SELECT 'dev' || p_partkey, '^2', 'npm', 'direct dev' FROM part""")
def manifest_packages(spark, sf_dir):
    content = F.format_string('{"dependencies": {"pkg%s": "1.%s"}, "devDependencies": {"dev%s": "^2"}}', _text("p_partkey"), _text("p_size"), _text("p_partkey"))
    return Pk.package_json(table(spark, sf_dir, "part").select(F.concat(F.lit("m"), _text("p_partkey"), F.lit("/package.json")).alias("path"), content.alias("content")))


@query("""SELECT 'org.x:p' || p_partkey AS name, '1.' || p_size AS version, 'gradle' AS source, 'direct main' AS dependency_type FROM part UNION ALL SELECT 'libs.t' || p_partkey, 'any', 'gradle', 'direct dev' FROM part""")
def build_packages(spark, sf_dir):
    content = F.format_string('dependencies {\n  implementation("org.x:p%s:1.%s")\n  testImplementation(libs.t%s)\n}\n', _text("p_partkey"), _text("p_size"), _text("p_partkey"))
    return Pk.gradle(table(spark, sf_dir, "part").select(F.concat(F.lit("m"), _text("p_partkey"), F.lit("/build.gradle.kts")).alias("path"), content.alias("content")))


def _locales(spark, sf_dir):
    """A locale file of each nation; every fifth names no locale, every seventh cannot be read."""
    k = _text("n_nationkey")
    named = F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.format_string('"@@locale": "x%s", ', k))
    content = F.concat(F.lit("{"), named, F.format_string('"hello": "%s", "n": 5, "@hello": {}', F.col("n_name")), F.when(F.col("n_nationkey") % 7 == 6, "").otherwise("}"))
    return table(spark, sf_dir, "nation").select(F.format_string("l10n/f%s.arb", k).alias("path"), content.alias("content"))


@query("""SELECT 'l10n/f' || n_nationkey || '.arb' AS path, CASE WHEN n_nationkey % 5 = 0 THEN 'f' || n_nationkey ELSE 'x' || n_nationkey END AS locale, 'hello' AS key, n_name AS value FROM nation WHERE n_nationkey % 7 <> 6""")
def locale_entries(spark, sf_dir):
    return T.translations(_locales(spark, sf_dir))


@query("SELECT 'l10n/f' || n_nationkey || '.arb' AS path FROM nation WHERE n_nationkey % 7 = 6")
def locale_unreadable(spark, sf_dir):
    return T.unreadable(_locales(spark, sf_dir))


@query("""SELECT 'e' || event_id || CASE WHEN event_id % 2 = 0 THEN '.dart' ELSE '.txt' END AS path, CASE WHEN event_type = 'error' THEN 'Removed' ELSE 'Modified' END AS op FROM events WHERE event_id % 2 = 0""")
def watched_events(spark, sf_dir):
    path = F.concat(F.lit("e"), _text("event_id"), F.when(F.col("event_id") % 2 == 0, ".dart").otherwise(".txt"))
    return C.file_events(table(spark, sf_dir, "events").select(path.alias("path"), F.when(F.col("event_type") == "error", "remove").otherwise("change").alias("op")))


@query("""WITH e AS (SELECT user_id AS path, arg_max(event_type, event_id) AS op FROM events GROUP BY user_id)
    SELECT 'u' || path AS path, CASE WHEN op = 'error' THEN 'delete' WHEN path % 2 = 0 THEN 'skip' ELSE 'upsert' END AS action FROM e""")
def incremental_work(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("u"), _text("user_id"))
    changes = e.select(path.alias("path"), F.when(F.col("event_type") == "error", "Removed").otherwise("Modified").alias("op"), F.md5(_text("user_id")).alias("hash"), F.col("event_id").alias("ts"))
    stored = e.select(path.alias("path"), F.when(F.col("user_id") % 2 == 0, F.md5(_text("user_id"))).otherwise("old").alias("hash")).distinct()
    return C.incremental(stored, changes).select("path", "action")
