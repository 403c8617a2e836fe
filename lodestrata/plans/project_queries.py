"""Queries over project files: exclusions, manifests, locale administration and messages, styles, searches by mode, warnings and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import audit as A
from lodestrata.operators import edits as E
from lodestrata.operators import graph as G
from lodestrata.operators import l10n as T
from lodestrata.operators import search as Q
from lodestrata.parse import tables as P
from lodestrata.plans.adapters import TRADE, query, table, trade_edges
from lodestrata.plans.source_queries import _LONG, _PATH, _sources, _symbols
from lodestrata.sources import files as Fs
from lodestrata.sources import packages as Pk
from lodestrata.sources import store as St
from lodestrata.streaming import changes as C


def _text(c: str):
    return F.col(c).cast("string")


# ---- configuration
@query("""SELECT 'p' || p_partkey || '/analysis_options.yaml' AS path, unnest([4, 6]) AS line, unnest(['lib/' || p_partkey || '/**', '**/*.g' || p_size || '.dart']) AS "glob" FROM part WHERE p_size % 2 = 1
    UNION ALL SELECT 'p' || p_partkey || '/analysis_options.yaml', 2, unnest(['a' || p_partkey || '/*.dart', 'b.dart']) FROM part WHERE p_size % 2 = 0""")
def analysis_excludes(spark, sf_dir):
    block = "analyzer:\n  exclude:\n    # made by tools\n    - 'lib/%2$s/**'\n\n    - \"**/*.g%3$s.dart\"\n  errors:\n    - no\nlinter:\n  exclude:\n    - never\n"
    listed = "analyzer:\n  exclude: ['a%2$s/*.dart', b.dart]\n    - late\n  errors:\n    - no\n"
    p = table(spark, sf_dir, "part")
    content = F.when(F.col("p_size") % 2 == 1, F.format_string(block, F.lit(""), _text("p_partkey"), _text("p_size"))).otherwise(F.format_string(listed, F.lit(""), _text("p_partkey")))
    return Fs.analysis_excludes(p.select(F.format_string("p%s/analysis_options.yaml", _text("p_partkey")).alias("path"), content.alias("content")))


@query("""SELECT 'p' || p_partkey || '/pubspec.yaml' AS path, 'any version' AS warning, unnest(['d' || p_partkey, 'e' || p_size]) AS name FROM part
    UNION ALL SELECT 'p' || p_partkey || '/pubspec.yaml', 'no description', NULL FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'p' || p_partkey || '/pubspec.yaml', 'no sdk constraint', NULL FROM part WHERE p_size % 3 = 0""")
def manifest_report(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    content = F.concat(
        F.lit("name: x\n"), F.when(F.col("p_size") % 2 == 0, "description:\n").otherwise("description: of use\n"), F.lit("environment:\n"), F.when(F.col("p_size") % 3 == 0, "").otherwise("  sdk: '>=3.0.0'\n"),
        F.format_string("dependencies:\n  d%s: any\n  good: ^1.0.0\ndev_dependencies:\n  e%s:\n    path: ../e\n", _text("p_partkey"), _text("p_size")),
    )
    return Pk.manifest_report(p.select(F.format_string("p%s/pubspec.yaml", _text("p_partkey")).alias("path"), content.alias("content")))


@query("SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents")
def table_counts(spark, sf_dir):
    known = {t: table(spark, sf_dir, t) for t in ("part", "orders", "documents")}
    return St.counted(known, "part").unionByName(St.counted(known, "orders")).unionByName(St.counted(known, "documents"))


@query("SELECT 'k' || p_size AS key, CASE WHEN p_size % 2 = 0 THEN 'new' || max(p_brand) ELSE 'old' END AS value FROM part WHERE p_size IN (3, 4, 5, 6) GROUP BY p_size")
def metadata_values(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("key", F.concat(F.lit("k"), _text("p_size")))
    old = p.select("key", F.lit("old").alias("value")).distinct()
    fresh = p.where("p_size % 2 = 0").select("key", F.concat(F.lit("new"), "p_brand").alias("value"))
    return St.metadata_get(St.metadata_set(old, fresh), "k3", "k4", "k5", "k6")


_UNIT, _EOL = "CASE p_size % 3 WHEN 0 THEN '    ' WHEN 1 THEN chr(9) ELSE '  ' END", "CASE WHEN p_size % 2 = 0 THEN chr(13) || chr(10) ELSE chr(10) END"


@query(f"""WITH p AS (SELECT *, {_UNIT} AS unit, {_EOL} AS eol, 'f' || p_partkey || '.arb' AS path FROM part)
    SELECT path, '{{' || eol || unit || '"a": {{' || eol || unit || unit || '"b": ' || p_partkey || eol || unit || '}}' || eol || '}}' || CASE WHEN p_size % 5 = 0 THEN '' ELSE eol END AS content FROM p
    UNION ALL SELECT path || '.bak', '{{' || eol || unit || '"old": 1' || eol || '}}' || CASE WHEN p_size % 5 = 0 THEN '' ELSE eol END FROM p""".replace("{{", "{").replace("}}", "}"))
def rewritten_files(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path, odd = F.concat(F.lit("f"), _text("p_partkey"), F.lit(".arb")), F.col("p_size") % 3
    unit, eol = F.when(odd == 0, "    ").when(odd == 1, "\t").otherwise("  "), F.when(F.col("p_size") % 2 == 0, "\r\n").otherwise("\n")
    old = F.concat(F.lit("{"), eol, unit, F.lit('"old": 1'), eol, F.lit("}"), F.when(F.col("p_size") % 5 == 0, "").otherwise(eol))
    fresh = F.concat(F.lit('{\n  "a": {\n    "b": '), _text("p_partkey"), F.lit("\n  }\n}\n"))
    return E.rewritten(p.select(path.alias("path"), old.alias("content")), p.select(path.alias("path"), fresh.alias("content")))


# ---- locales
def _arbs(spark, sf_dir):
    """A locale file of each nation, named after a letter."""
    letter = F.expr("char(97 + n_nationkey)")
    n = table(spark, sf_dir, "nation").where("n_nationkey < 26")
    entry = '{"@@locale": "%1$s", "hi": "It\'s {who} of {n}", "@hi": {"description": "a $ sign", "placeholders": {"n": {"type": "INT"}, "at": {"type": "DateTime"}}}, "left": "{count, plural, =0{none} one{one} =1{again} other{{count} of %2$s}}", "who": "{sex, select, male{he} other{they}}", "plain": "%2$s"}'
    locale = F.concat(F.lit("x"), letter)
    return n.select(F.concat(F.lit("l10n/app_"), locale, F.lit(".arb")).alias("path"), F.format_string(entry, locale, F.col("n_name")).alias("content"))


_XX = "'x' || chr(97 + n_nationkey)"


@query(f"SELECT {_XX} AS locale FROM nation WHERE n_nationkey < 26")
def locale_list(spark, sf_dir):
    return T.locale_names(_arbs(spark, sf_dir))


@query(f"SELECT 'l10n/app_' || {_XX} || '.arb' AS path FROM nation WHERE n_nationkey < 26 AND n_nationkey <> 3 UNION ALL SELECT 'l10n/app_zz.arb'")
def locale_changes(spark, sf_dir):
    f = _arbs(spark, sf_dir)
    return T.without_locale(f, "xd").select("path").unionByName(T.added_locale_path(f, "zz"))


@query(f"SELECT 'l10n/app_' || {_XX} || '.arb' AS path, 'hi' AS key, unnest(['n', 'at']) AS name, unnest(['int', 'DateTime']) AS type FROM nation WHERE n_nationkey < 26")
def placeholder_types(spark, sf_dir):
    return T.placeholder_types(_arbs(spark, sf_dir)).select("path", "key", "name", "type")


_TAIL = "      name: ''%s'',\n      desc: ''%s'',\n      args: [%s],\n    );\n  }'"
_MEMBERS = (
    ("hi", "'  String hi(int n, DateTime at, String who) {\n    return Intl.message(\n      ''It\\''s ${who} of ${n}'',\n" + _TAIL % ("hi", "a \\$ sign", "n, at, who")),
    ("left", "'  String left(num count) {\n    return Intl.plural(\n      count,\n      zero: ''none'',\n      one: ''one'',\n      other: ''${count} of ' || n_name || ''',\n" + _TAIL % ("left", "", "count")),
    ("who", "'  String who(String sex) {\n    return Intl.select(\n      sex,\n      {\n        ''male'': ''he'',\n        ''other'': ''they'',\n      },\n" + _TAIL % ("who", "", "sex")),
    ("plain", "'  String get plain {\n    return Intl.message(\n      ''' || n_name || ''',\n" + _TAIL % ("plain", "", "")),
)


@query(" UNION ALL ".join(f"SELECT '{key}' AS key, {text} AS member FROM nation WHERE n_nationkey = 4" for key, text in _MEMBERS))
def message_members(spark, sf_dir):
    return T.message_members(_arbs(spark, sf_dir), "xe")


@query(f"""SELECT 'l10n/app_' || {_XX} || '.arb:translation:plain' AS id, 'translation' AS kind, 'plain' AS name, 'l10n/app_' || {_XX} || '.arb' AS path, n_name AS comments FROM nation WHERE n_nationkey < 26""")
def translation_docs(spark, sf_dir):
    return P.translation_docs(T.translations(_arbs(spark, sf_dir))).where("name = 'plain'").select("id", "kind", "name", "path", "comments")


# ---- searches and counters
_RUNS = f"SELECT 'run7' AS name, 'function_definition' AS type, {_PATH} AS path, 4 AS line FROM part WHERE p_size = 7"


def _found(spark, sf_dir, *how, **more):
    """All that is found, as the SQL has no limit.  A direct search reads the lines alone, so its symbols are not parsed."""
    files = _sources(spark, sf_dir)
    symbols = P.parsed(files) if more.get("direct") else _symbols(spark, sf_dir)
    return Q.tool_search(symbols, files, *how, k=None, **more).select("name", "type", "path", "line")


@query(f"""SELECT 'helper7' AS name, 'function_definition' AS type, {_PATH} AS path, CASE WHEN {_LONG} THEN 12 ELSE 9 END AS line FROM part WHERE p_size = 7 UNION ALL SELECT 'helper7', 'function_call', {_PATH}, 5 FROM part WHERE p_size = 7""")
def search_both(spark, sf_dir):
    return _found(spark, sf_dir, "HELPER7", "call")


@query(_RUNS)
def search_definitions(spark, sf_dir):
    return _found(spark, sf_dir, "run7", None, "definitions")


@query(f"SELECT 'Part' || p_partkey AS name, 'class_definition' AS type, {_PATH} AS path, 2 AS line FROM part WHERE contains(CAST(p_partkey AS VARCHAR), '7')")
def search_widgets(spark, sf_dir):
    return _found(spark, sf_dir, "7", "widget", "definitions")


@query(f"SELECT 'Part' || p_partkey AS name, 'class_definition' AS type, {_PATH} AS path, 2 AS line FROM part WHERE starts_with(CAST(p_partkey AS VARCHAR), '19')")
def search_direct(spark, sf_dir):
    return _found(spark, sf_dir, "part19", "class", "definitions", direct=True)


@query(f"""SELECT count(*) AS files, count(*) AS classes, CAST(sum(CASE WHEN {_LONG} THEN 3 ELSE 2 END) AS BIGINT) AS functions, count(*) AS properties, 0 AS enums, 0 AS mixins, 0 AS extensions, 0 AS typedefs,
    (SELECT 4 * count(*) FROM nation WHERE n_nationkey < 26) AS translations FROM part""")
def symbol_counts(spark, sf_dir):
    row = P.symbol_counts(_symbols(spark, sf_dir), _sources(spark, sf_dir), T.translations(_arbs(spark, sf_dir)))
    return row.select("files", "classes", "functions", "properties", "enums", "mixins", "extensions", "typedefs", "translations")


# ---- warnings and reports
_CONTROLS = ("Switch(\n  value: true,\n  onChanged: null,\n)", "Switch(value: on, onChanged: null)", "Checkbox(\n  checked = false,\n  onCheckedChange = { it -> }\n)", "Radio(value: true, onChanged: save)")


@query("""SELECT 'lib/e' || event_id || '.dart' AS path, unnest([2, 6]) AS line FROM events WHERE event_id % 4 IN (0, 2)""")
def unbound_inputs(spark, sf_dir):
    one = F.get(F.array(*map(F.lit, _CONTROLS)), (F.col("event_id") % 4).cast("int"))
    content = F.concat(F.lit("x\n"), one, F.lit("\n"), one, F.lit("\n"))
    f = table(spark, sf_dir, "events").select(F.format_string("lib/e%s.dart", _text("event_id")).alias("path"), content.alias("content"))
    return A.unbound_inputs(f).select("path", "line")


@query("""WITH b AS (SELECT 'lib/' || (p_partkey % 50) || '.dart' AS path, p_partkey AS line, 'f' || p_partkey AS name, 'C' AS parent, p_size AS h, 45 + p_size AS len FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY path, line) AS r, count(*) OVER (PARTITION BY h) AS n FROM b WHERE len >= 50),
    f AS (SELECT * FROM r WHERE n > 1), few AS (SELECT h, r, name || ' in ' || split_part(path, '/', 2) AS said FROM f WHERE r <= 4)
    SELECT path, line, name, 'project' AS scope, n, (SELECT string_agg(said, ', ' ORDER BY r) FROM (SELECT said, r FROM few WHERE few.h = f.h AND few.r <> f.r ORDER BY r LIMIT 3)) AS others FROM f
    UNION ALL SELECT a.path, a.line, a.name, 'file', 1 + count(*), string_agg('C.' || b.name || ' (line ' || b.line || ')', ', ' ORDER BY b.line) FROM b a JOIN b ON a.path = b.path AND a.h = b.h AND a.line <> b.line WHERE a.len >= 80 GROUP BY a.path, a.line, a.name""")
def duplicate_warnings(spark, sf_dir):
    k = F.col("p_partkey")
    b = table(spark, sf_dir, "part").select(F.concat(F.lit("lib/"), (k % 50).cast("string"), F.lit(".dart")).alias("path"), k.alias("line"), F.concat(F.lit("f"), k.cast("string")).alias("name"), F.lit("C").alias("parent"), F.lit("method").alias("type"), F.md5(_text("p_size")).alias("body_hash"), (F.col("p_size") + 45).alias("body_length"))
    return A.duplicate_warnings(b)


def _log(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "error").otherwise("warning")
    text = F.concat(F.lit("src/u"), _text("user_id"), F.lit(".ts("), (F.col("event_id") + 1).cast("string"), F.lit(",5): "), kind, F.lit(" TS1005: ';' expected."))
    return A.diagnostics(table(spark, sf_dir, "events").select(text.alias("text")))


@query("SELECT 'src/u' || user_id || '.ts' AS file, event_id + 1 AS line FROM events WHERE event_type = 'error' AND ends_with(CAST(user_id AS VARCHAR), '3')")
def diagnostics_filtered(spark, sf_dir):
    return A.diagnostics_where(_log(spark, sf_dir), "3.TS", "ERROR").select("file", F.col("line").cast("long").alias("line"))


@query("SELECT count(CASE WHEN event_type = 'error' THEN 1 END) = 0 AS success, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events UNION ALL SELECT false, 0, 0")
def diagnostics_report(spark, sf_dir):
    return A.diagnostics_report(_log(spark, sf_dir), 1, "src").unionByName(A.diagnostics_report(_log(spark, sf_dir), 1, "lib"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, CASE WHEN event_type = 'error' THEN 'Removed' ELSE 'Modified' END AS op FROM events),
    n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, op = 'Removed') AS next FROM e)
    SELECT user_id, CASE WHEN op = 'Removed' THEN t ELSE t + 21600000 END AS at, op FROM n WHERE op = 'Removed' OR next IS NULL OR next - t >= 21600000""")
def debounce_removals(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("op", F.when(F.col("event_type") == "error", "Removed").otherwise("Modified"))
    return C.debounced_changes(e, ["user_id"], 6 * 3600 * 1000)


@query(f"""WITH RECURSIVE {TRADE}, reach AS (SELECT 'NATION_5' AS node, 0 AS hops UNION SELECT e.src, r.hops + 1 FROM reach r JOIN trade e ON e.dst = r.node WHERE r.hops < 3)
    SELECT node AS entry, min(hops) AS hops FROM reach GROUP BY node""")
def impact_flows(spark, sf_dir):
    entries = table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"), F.col("n_name").alias("entry"))
    return G.impact_flows(trade_edges(spark, sf_dir), spark.createDataFrame([("NATION_5",)], "node string"), entries, most=4, k=1000).select("entry", "hops")
