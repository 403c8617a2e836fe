"""Queries that run the parsers and the operators over parsed code, on source files written from ``part`` (one class each)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import audit as A
from lodestrata.operators import graph as G
from lodestrata.operators import lines as L
from lodestrata.operators import resolve as R
from lodestrata.parse import tables as P
from lodestrata.plans.adapters import lines_sql, query, spread, table
from lodestrata.sources import packages as Pk
from lodestrata.sources.shared import written

# the files: an import, a class with a field, a method and, for even sizes, a release, and a function
_RELEASE = "  void dispose() {\n    c%s.dispose();\n  }\n"


def _sources(spark, sf_dir):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    head = F.format_string(
        "import 'p%s.dart';\nclass Part%s extends State<Base%s> {\n  final TextEditingController c%s = TextEditingController();\n  void run%s() {\n    helper%s();\n    load('assets/p%s.png');\n  }\n",
        (F.col("p_partkey") % 7).cast("string"), k, (F.col("p_size") % 5).cast("string"), size, size, size, (F.col("p_partkey") * 2).cast("string"),
    )
    release = F.when(F.col("p_size") % 2 == 0, F.format_string(_RELEASE, size)).otherwise("")
    content = F.concat(head, release, F.format_string("}\nvoid helper%s() {\n  return;\n}\n", size))
    parts = spread(spark, table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return parts.select(F.concat(F.lit("lib/p"), k, F.lit(".dart")).alias("path"), content.alias("content"))


_PATH, _LONG = "'lib/p' || p_partkey || '.dart'", "p_size % 2 = 0"
_SOURCES = f"""(SELECT {_PATH} AS path, 'import ''p' || (p_partkey % 7) || '.dart'';' || chr(10) || 'class Part' || p_partkey || ' extends State<Base' || (p_size % 5) || '> {{' || chr(10)
    || '  final TextEditingController c' || p_size || ' = TextEditingController();' || chr(10) || '  void run' || p_size || '() {{' || chr(10) || '    helper' || p_size || '();' || chr(10)
    || '    load(''assets/p' || (p_partkey * 2) || '.png'');' || chr(10) || '  }}' || chr(10) || CASE WHEN {_LONG} THEN '  void dispose() {{' || chr(10) || '    c' || p_size || '.dispose();' || chr(10) || '  }}' || chr(10) ELSE '' END
    || '}}' || chr(10) || 'void helper' || p_size || '() {{' || chr(10) || '  return;' || chr(10) || '}}' || chr(10) AS content FROM part)""".replace("{{", "{").replace("}}", "}")


def _symbols(spark, sf_dir):
    """Parsed once: the queries' branches read the written table."""
    return written(P.parsed(_sources(spark, sf_dir)), "parsed")


def _classes(s):
    return P.of_kind(s, "class").select("path", "name", "line", "extends_class", "mixins", "implements")


def _functions(s):
    return P.of_kind(s, "function").select("path", "name", "line", F.col("parent").alias("parent_class"))


def _calls(s):
    return P.of_kind(s, "call").select("path", "line", "name", "receiver", F.col("parent").alias("caller_class"), "caller_function")


def _imports(s, spark, sf_dir):
    specs = P.of_kind(s, "import").select("path", F.col("name").alias("spec"))
    return R.resolve_imports(specs, _sources(spark, sf_dir)).select("path", "spec", "target")


@query(f"""SELECT {_PATH} AS path, 'class' AS kind, 'Part' || p_partkey AS name, NULL AS parent, 2 AS line, CASE WHEN {_LONG} THEN 11 ELSE 8 END AS line_end FROM part
    UNION ALL SELECT {_PATH}, 'function', 'run' || p_size, 'Part' || p_partkey, 4, 7 FROM part UNION ALL SELECT {_PATH}, 'function', 'dispose', 'Part' || p_partkey, 8, 10 FROM part WHERE {_LONG}
    UNION ALL SELECT {_PATH}, 'function', 'helper' || p_size, NULL, CASE WHEN {_LONG} THEN 12 ELSE 9 END, CASE WHEN {_LONG} THEN 14 ELSE 11 END FROM part""")
def parse_symbols(spark, sf_dir):
    return _symbols(spark, sf_dir).where("kind in ('class', 'function')").select("path", "kind", "name", "parent", "line", "line_end")


@query(f"""SELECT {_PATH} AS path, 'c' || p_size AS name, 'TextEditingController' AS type, 'Part' || p_partkey AS parent, TRUE AS is_final FROM part""")
def parse_properties(spark, sf_dir):
    return P.of_kind(_symbols(spark, sf_dir), "property").select("path", "name", "type", "parent", "is_final")


_HELPER = "path || ':helper' || p_size"


@query(f"""SELECT path, line, name, target, how FROM (SELECT {_PATH} AS path, p_size FROM part) p, LATERAL (SELECT 3 AS line, 'TextEditingController' AS name, NULL AS target, NULL AS how
    UNION ALL SELECT 5, 'helper' || p_size, {_HELPER}, 'same_file' UNION ALL SELECT 6, 'load', NULL, NULL) c""")
def call_resolution_priority(spark, sf_dir):
    s = _symbols(spark, sf_dir)
    classes = _classes(s)
    own = classes.select(F.col("name").alias("node"), F.col("name").alias("ancestor"), F.lit(0).alias("depth"))
    resolved = R.resolve_calls(_calls(s).where("receiver is null"), _functions(s), classes.select("path", "name"), own, _imports(s, spark, sf_dir).where("target is not null"))
    return resolved.select("path", "line", "name", "target", "how")


@query(f"""WITH p AS (SELECT {_PATH} AS path, * FROM part) SELECT 'file:' || path AS src, 'class:Part' || p_partkey AS dst, 'contains' AS type FROM p
    UNION ALL SELECT 'class:Part' || p_partkey, 'method:Part' || p_partkey || '.run' || p_size, 'contains' FROM p UNION ALL SELECT 'class:Part' || p_partkey, 'method:Part' || p_partkey || '.dispose', 'contains' FROM p WHERE {_LONG}
    UNION ALL SELECT 'file:' || path, 'func:helper' || p_size, 'contains' FROM p UNION ALL SELECT 'file:' || path, 'file:lib/p' || (p_partkey % 7) || '.dart', 'imports' FROM p WHERE p_partkey % 7 IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'class:Part' || p_partkey, 'class:State<Base' || (p_size % 5) || '>', 'extends' FROM p UNION ALL SELECT 'method:Part' || p_partkey || '.run' || p_size, 'func:helper' || p_size, 'calls' FROM p""")
def symbol_graph(spark, sf_dir):
    s = _symbols(spark, sf_dir)
    return G.symbol_graph(_sources(spark, sf_dir), _classes(s), _functions(s), _imports(s, spark, sf_dir), _calls(s).where("receiver is null"))[1]


@query(f"SELECT 'lib/p' || (p_partkey % 7) || '.dart' AS node, count(*) AS n FROM part WHERE p_partkey % 7 IN (SELECT p_partkey FROM part) AND p_partkey <> p_partkey % 7 GROUP BY 1 ORDER BY n DESC, node LIMIT 1")
def most_imported(spark, sf_dir):
    edges = _imports(_symbols(spark, sf_dir), spark, sf_dir).where("target is not null").select(F.col("path").alias("src"), F.col("target").alias("dst"))
    return G.adjacency(edges.where("src != dst")).select("node", F.col("n_in").alias("n")).orderBy(F.desc("n"), "node").limit(1)


@query(f"SELECT {_PATH} AS path, 5 AS line, 'call' AS kind FROM part WHERE p_size = 7 UNION ALL SELECT {_PATH}, 9, 'word' FROM part WHERE p_size = 7")
def reference_union_dedup(spark, sf_dir):
    s, f = _symbols(spark, sf_dir), _sources(spark, sf_dir)
    return L.references(_calls(s), _classes(s), L.lines(f), "helper7").select("path", "line", "kind")


@query(f"""SELECT 'method' AS kind, line, CASE WHEN line < 4 THEN 'before' WHEN line < 8 THEN 'body' ELSE 'after' END AS part, text FROM {lines_sql(_SOURCES)}
    WHERE path = (SELECT min({_PATH}) FROM part WHERE p_size = 7) AND line <= 10""")
def fragment_priority(spark, sf_dir):
    return L.fragment(P.symbol_spans(_symbols(spark, sf_dir)), L.lines(_sources(spark, sf_dir)), "run7").select("kind", "line", "part", "text")


@query(f"SELECT {_PATH} AS path, 1 AS line FROM part WHERE p_partkey % 7 = 3")
def reverse_deps_lines(spark, sf_dir):
    return L.reverse_import_lines(L.lines(_sources(spark, sf_dir)), "lib/p3.dart").select("path", "line")


@query(f"SELECT path, line, 'class' AS kind, 'Part' || p_partkey AS name FROM (SELECT {_PATH} AS path, 2 AS line, p_partkey FROM part WHERE starts_with(CAST(p_partkey AS VARCHAR), '1')) ORDER BY path LIMIT 50")
def direct_search_defs(spark, sf_dir):
    return L.direct_definitions(L.lines(_sources(spark, sf_dir)), "part1")


@query(f"SELECT {_PATH} AS path, 'c' || p_size AS name, 'TextEditingController' AS type FROM part WHERE p_size % 2 = 1")
def leak_candidates(spark, sf_dir):
    return A.leak_candidates(_sources(spark, sf_dir))


@query("SELECT 'assets/p' || p_partkey || '.png' AS path, p_size AS size FROM part WHERE p_partkey NOT IN (SELECT p_partkey * 2 FROM part)")
def unused_assets(spark, sf_dir):
    assets = table(spark, sf_dir, "part").select(F.concat(F.lit("assets/p"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), F.col("p_size").alias("size"))
    return A.unused_assets(assets, _sources(spark, sf_dir))


@query(f"""SELECT count(*) AS files, 0 AS classes, count(*) AS widgets, CAST(sum(CASE WHEN {_LONG} THEN 3 ELSE 2 END) AS BIGINT) AS functions, CAST(sum(CASE WHEN {_LONG} THEN 2 ELSE 1 END) AS BIGINT) AS methods,
    0 AS enums, 0 AS mixins, 0 AS extensions, count(*) AS imports, 0 AS root_widgets FROM part""")
def stats_global(spark, sf_dir):
    return P.global_stats(_symbols(spark, sf_dir), _sources(spark, sf_dir), "ts")


def _made(spark, sf_dir, name: str, path: str, pattern: str, *columns):
    """Files (path, content) of one table: a path and a content with columns filled in."""
    t = table(spark, sf_dir, name)
    return t.select(F.format_string(path, F.col(columns[0]).cast("string")).alias("path"), F.format_string(pattern, *[F.col(c).cast("string") for c in columns]).alias("content"))


@query("SELECT 'pkg_' || p_partkey AS name, '1.' || p_size || '.0' AS version, 'hosted' AS source, 'direct main' AS dependency_type FROM part")
def package_list(spark, sf_dir):
    f = _made(spark, sf_dir, "part", "p%s/pubspec.lock", 'packages:\n  pkg_%s:\n    dependency: "direct main"\n    source: hosted\n    version: "1.%s.0"\nsdks:\n  dart: "3"\n', "p_partkey", "p_size")
    return Pk.pubspec_lock(f)


@query("""SELECT 'l' || p_partkey || '.xml' AS path, 's' || p_size AS name, p_name AS value FROM part
    UNION ALL SELECT 'l' || p_partkey || '.xml', 'c' || p_partkey, '#FF0000' FROM part""")
def resource_values(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    content = F.concat(F.lit('<resources>\n<string name="s'), F.col("p_size").cast("string"), F.lit('">'), "p_name", F.lit('</string>\n<color name="c'), F.col("p_partkey").cast("string"), F.lit('">#FF0000</color>\n</resources>'))
    f = t.select(F.concat(F.lit("l"), F.col("p_partkey").cast("string"), F.lit(".xml")).alias("path"), content.alias("content"))
    return P.of_kind(P.parsed(f), "variable").select("path", "name", "value")


@query("""SELECT 'd' || p_partkey || '.md' AS path, p_name AS name, 'H1' AS kind, 1 AS line FROM part UNION ALL SELECT 'd' || p_partkey || '.md', p_brand, 'H2', 5 FROM part""")
def outline(spark, sf_dir):
    f = _made(spark, sf_dir, "part", "d%s.md", "# %2$s\n\nsome text\n\n## %3$s\n", "p_partkey", "p_name", "p_brand")
    return P.quick_outline(P.parsed(f)).select("path", "name", "kind", "line")


_KINDS = ("// TODO: later", "onTap: null,", "return Placeholder();", "final mockUsers = [];", "go();")


@query("""SELECT 'lib/e' || event_id || '.dart' AS path, ['comment', 'callback', 'widget', 'data'][1 + event_id % 5] AS category, ['info', 'info', 'warning', 'warning'][1 + event_id % 5] AS severity FROM events WHERE event_id % 5 < 4""")
def mockup_findings(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 5).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("lib/e"), F.col("event_id").cast("string"), F.lit(".dart")).alias("path"), F.lit(1).alias("line"), text.alias("text"))
    return A.mockups(rows).select("path", "category", "severity")
