"""Components, risk and flows over the orders of each customer; line states, block ends and indentation over files written from ``lineitem``;
substring joins and the stored index over documents.

All tables are read whole, and the graphs and files grow with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import audit as A
from lodestrata.operators import components as C
from lodestrata.operators import graph as G
from lodestrata.operators import l10n as T
from lodestrata.operators import lexical as X
from lodestrata.operators import lines as L
from lodestrata.operators import substrings as U
from lodestrata.operators.resolve import loose_targets, resolve_calls
from lodestrata.operators.stored_index import StoredIndex
from lodestrata.parse import tables as P
from lodestrata.plans.adapters import query, spread, table
from lodestrata.plans.search_queries import _DOCS, _bm25_sql, _docs, _top
from lodestrata.plans.source_queries import _LONG, _PATH, _sources, _symbols
from lodestrata.sources import packages as Pk
from lodestrata.sources.shared import shared_dir, written

# ---- a graph of orders: each leads to the customer's next one, an urgent one to the one after it too, and a pending one back by three
_OG = """o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
    og AS (SELECT a.k AS src, b.k AS dst FROM o a JOIN o b ON a.c = b.c AND (b.r = a.r + 1 OR (a.p = '1-URGENT' AND b.r = a.r + 2) OR (a.s = 'P' AND b.r = a.r - 3)))"""
_REACH = f"{_OG}, reach AS (SELECT src, dst FROM og UNION SELECT r.src, e.dst FROM reach r JOIN og e ON e.src = r.dst)"


def _ordered(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.row_number().over(w).alias("r"))


def _order_graph(spark, sf_dir):
    """The next orders and the one three back come from the customer's own window, so orders are shuffled once and meet no copy of themselves."""
    w = Window.partitionBy("c").orderBy("r")
    o = _ordered(spark, sf_dir)
    near = o.where("c is not null").select("k", "p", "s", F.lead("k", 1).over(w).alias("one"), F.lead("k", 2).over(w).alias("two"), F.lag("k", 3).over(w).alias("back"))
    goes = F.array_compact(F.array(F.col("one"), F.when(F.col("p") == "1-URGENT", F.col("two")), F.when(F.col("s") == "P", F.col("back"))))
    return near.select(F.col("k").alias("src"), F.explode(goes).alias("dst"))


@query(f"""WITH RECURSIVE {_REACH}, n AS (SELECT src AS node FROM og UNION SELECT dst FROM og),
    both_ways AS (SELECT a.src AS node, min(a.dst) AS least FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
    SELECT node, least(node, coalesce(least, node)) AS component FROM n LEFT JOIN both_ways USING (node)""")
def strong_components(spark, sf_dir):
    return C.strong_components(_order_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {_REACH} SELECT src AS node FROM reach WHERE src = dst")
def order_cycle_nodes(spark, sf_dir):
    return G.nodes_on_cycles(_order_graph(spark, sf_dir))


@query(f"""WITH RECURSIVE {_REACH}, n AS (SELECT dst AS node, count(*) AS n FROM reach WHERE src <> dst GROUP BY dst)
    SELECT o_orderkey AS node, CASE WHEN n > 15 THEN 'critical' WHEN n > 5 THEN 'high' WHEN n > 0 THEN 'medium' ELSE 'low' END AS risk FROM orders LEFT JOIN n ON node = o_orderkey""")
def order_risk(spark, sf_dir):
    return C.risk_of(_order_graph(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node")))


_WAYS = """way AS (SELECT k AS node, k AS target, [k] AS way FROM o WHERE s = 'F' UNION ALL SELECT e.src, w.target, list_prepend(e.src, w.way) FROM way w JOIN og e ON e.dst = w.node WHERE len(w.way) < 6 AND NOT list_contains(w.way, e.src)),
    flows AS (SELECT 'order ' || k AS entry, node, target, len(way) - 1 AS hops, array_to_string(way, ' -> ') AS flow, c FROM way JOIN o ON o.k = way.node WHERE o.p = '1-URGENT')"""


def _entries(o):
    return o.where("p = '1-URGENT'").select(F.col("k").alias("node"), F.concat(F.lit("order "), F.col("k").cast("string")).alias("entry"))


@query(f"WITH RECURSIVE {_OG}, {_WAYS} SELECT entry, target, hops, flow FROM flows")
def order_flows(spark, sf_dir):
    """All ways of up to six orders from urgent orders to filled ones."""
    o = _ordered(spark, sf_dir)
    return G.all_flows(_order_graph(spark, sf_dir), _entries(o), o.where("s = 'F'").select(F.col("k").alias("node")), 6, 50, None).select("entry", "target", "hops", "flow")


@query(f"WITH RECURSIVE {_OG}, {_WAYS} SELECT entry, flow, hops, min('c' || c) AS path FROM flows GROUP BY entry, flow, hops")
def order_flows_by_file(spark, sf_dir):
    """The same flows by the changed file that causes them; a customer is a file."""
    o = _ordered(spark, sf_dir)
    symbols = o.where("s = 'F'").select(F.col("k").alias("node"), F.concat(F.lit("c"), F.col("c").cast("string")).alias("path"))
    return G.flows_by_file(_order_graph(spark, sf_dir), _entries(o), symbols, symbols.select("path"), 6, 50)


# ---- files of one line for each lineitem of a supplier, in eight forms
_FORMS = ("mark /* mark", "mark */ mark", "mark ''' mark", 'f("mark // {"); mark', "mark; // mark }", "mark {", "mark }", "r'\\' mark;")
#: What the SQL knows of each form: the places of its marks, and the state behind it, for a line that begins in code (c), a comment (b) or a string (t).
_PLACES = (
    ("cb", "b", "bb", "b", "ss", "t"), ("cc", "c", "bc", "c", "ss", "t"), ("cs", "t", "bb", "b", "sc", "c"), ("sc", "c", "bb", "b", "ss", "t"),
    ("cb", "c", "bb", "b", "ss", "t"), ("c", "c", "b", "b", "s", "t"), ("c", "c", "b", "b", "s", "t"), ("c", "c", "b", "b", "s", "t"),
)
_FORM_ROWS = ", ".join(f"({f}, '{start}', '{row[2 * k]}', '{row[2 * k + 1]}')" for f, row in enumerate(_PLACES) for k, start in enumerate("cbt"))
_STATES = f"""form(f, start, places, after) AS (VALUES {_FORM_ROWS}),
    line AS (SELECT 'src/s' || l_suppkey || '.ts' AS path, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS line, l_partkey % 8 AS f FROM lineitem),
    run AS (SELECT path, line, f, 'c' AS start FROM line WHERE line = 1 UNION ALL SELECT n.path, n.line, n.f, form.after FROM run r JOIN form ON form.f = r.f AND form.start = r.start JOIN line n ON n.path = r.path AND n.line = r.line + 1)"""


def _supplier_lines(spark, sf_dir):
    """Lineitems are shuffled once, by the path of their file, and sorted where they are."""
    text = lambda x: F.element_at(F.array(*map(F.lit, _FORMS)), (x["l_partkey"] % 8 + 1).cast("int"))
    path = F.concat(F.lit("src/s"), F.col("l_suppkey").cast("string"), F.lit(".ts"))
    rows = table(spark, sf_dir, "lineitem").select(path.alias("path"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("row"))
    files = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), text), "\n").alias("content"))
    return L.lines(files, "ts")


@query(f"""WITH RECURSIVE {_STATES}, m AS (SELECT path, line, unnest(range(0, len(places))) AS n, places FROM run JOIN form ON form.f = run.f AND form.start = run.start)
    SELECT path, line, CAST(n AS INTEGER) AS n, CASE places[n + 1] WHEN 'c' THEN 'code' WHEN 'b' THEN 'comment' ELSE 'string' END AS place FROM m""")
def match_places(spark, sf_dir):
    return X.matches(_supplier_lines(spark, sf_dir), "mark").select("path", "line", "n", "place")


@query(f"""WITH RECURSIVE {_STATES}, m AS (SELECT path, line, unnest(range(0, len(places))) AS n, places FROM run JOIN form ON form.f = run.f AND form.start = run.start)
    SELECT path, line, CAST(n AS INTEGER) AS n FROM m WHERE places[n + 1] = 'c'""")
def matches_in_code(spark, sf_dir):
    return X.matches(_supplier_lines(spark, sf_dir), "mark", comments=False, strings=False).select("path", "line", "n")


@query(f"""WITH RECURSIVE {_STATES}, code AS (SELECT path, line, CASE WHEN start = 'c' AND f = 5 THEN 1 WHEN start = 'c' AND f = 6 THEN -1 ELSE 0 END AS d, start = 'c' AND f IN (4, 7) AS stops FROM run),
    deep AS (SELECT path, line, d, stops, sum(d) OVER (PARTITION BY path ORDER BY line) AS depth FROM code),
    seen AS (SELECT path, line, depth - d AS depth, min(CASE WHEN d = 1 THEN line END) OVER w AS opened, min(CASE WHEN stops THEN line END) OVER w AS stopped FROM deep WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    shut AS (SELECT s.path, s.line, min(e.line) AS shut FROM seen s JOIN deep e ON e.path = s.path AND e.line >= s.line AND e.d = -1 AND e.depth = s.depth GROUP BY s.path, s.line)
    SELECT s.path, s.line, CASE WHEN opened IS NULL OR stopped <= opened THEN coalesce(stopped, shut) ELSE shut END AS line_end FROM seen s LEFT JOIN shut ON shut.path = s.path AND shut.line = s.line""")
def brace_ends(spark, sf_dir):
    return X.block_ends(None, _supplier_lines(spark, sf_dir))


_INDENTED = "line AS (SELECT l_suppkey AS path, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS line, CAST(l_quantity AS INTEGER) AS value FROM lineitem)"


@query(f"WITH {_INDENTED} SELECT s.path, s.line, max(p.line) AS parent_line FROM line s LEFT JOIN line p ON p.path = s.path AND p.line < s.line AND p.value < s.value GROUP BY s.path, s.line")
def indent_parents(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), F.row_number().over(w).alias("line"), F.concat(F.repeat(F.lit(" "), F.col("l_quantity").cast("int")), F.lit("node()")).alias("text"))
    return X.indent_tree(rows)


@query("""WITH line AS (SELECT doc_id AS path, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
    shown AS (SELECT path, line, length(regexp_extract(text, '^\\s*')) AS value FROM line WHERE trim(text) <> '')
    SELECT s.path, s.line, max(p.line) AS parent_line FROM shown s LEFT JOIN shown p ON p.path = s.path AND p.line < s.line AND p.value < s.value GROUP BY s.path, s.line""")
def document_outline(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return X.indent_tree(L.lines(files, "ts"))


# ---- calls to inherited methods: one class for each part, each below the one of half its number
def _class_files(spark, sf_dir):
    k, text = F.col("p_partkey"), lambda c: F.floor(c).cast("string")
    above = F.when(k >= 2, F.concat(F.lit(" extends Part"), text(k / 2))).otherwise("")
    run = F.when(F.col("p_size") % 3 == 0, "  void run() {\n  }\n").otherwise("")
    body = F.concat(F.lit("  void go() {\n    run();\n    this.run();\n    part"), text(k / 3), F.lit(".run();\n    Part"), text(k / 4), F.lit(".make();\n    helper"), text(k % 5), F.lit("();\n  }\n"))
    content = F.concat(F.lit("class Part"), text(k), above, F.lit(" {\n"), body, run, F.lit("}\n"))
    return spread(spark, table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.concat(F.lit("lib/k"), text(k), F.lit(".dart")).alias("path"), content.alias("content"))


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS k, p_partkey AS a, 0 AS d FROM part UNION ALL SELECT k, a // 2, d + 1 FROM up WHERE a >= 2),
    owner AS (SELECT k, arg_min(a, d) AS o FROM up JOIN part ON p_partkey = a WHERE p_size % 3 = 0 GROUP BY k),
    c AS (SELECT p.p_partkey AS k, mine.o AS mine, t.p_partkey AS third, its.o AS its, q.p_partkey AS quarter FROM part p LEFT JOIN owner mine ON mine.k = p.p_partkey LEFT JOIN part t ON t.p_partkey = p.p_partkey // 3
      LEFT JOIN owner its ON its.k = t.p_partkey LEFT JOIN part q ON q.p_partkey = p.p_partkey // 4),
    e AS (SELECT k, CASE WHEN mine IS NULL THEN 'func:run' ELSE 'method:Part' || mine || '.run' END AS dst FROM c
      UNION SELECT k, CASE WHEN third IS NOT NULL THEN 'method:Part' || coalesce(its, third) || '.run' WHEN mine IS NULL THEN 'func:run' ELSE 'method:Part' || mine || '.run' END FROM c
      UNION SELECT k, CASE WHEN quarter IS NULL THEN 'func:make' ELSE 'class:Part' || quarter END FROM c UNION SELECT k, 'func:helper' || k % 5 FROM c)
    SELECT 'method:Part' || k || '.go' AS src, dst, 'calls' AS type FROM e""")
def inherited_calls(spark, sf_dir):
    s = written(P.parsed(_class_files(spark, sf_dir)), "parsed")
    classes = P.of_kind(s, "class").select("name", "extends_class", "mixins", "implements")
    functions = P.of_kind(s, "function").select("name", F.col("parent").alias("parent_class"))
    return G.call_edges(P.of_kind(s, "call").select("path", "name", "receiver", F.col("parent").alias("caller_class"), "caller_function"), functions, classes)


def _file(k: str) -> str:
    return f"'lib/k' || {k} || '.dart'"


@query(f"""WITH RECURSIVE up AS (SELECT p_partkey AS k, p_partkey AS a, 0 AS d FROM part UNION ALL SELECT k, a // 2, d + 1 FROM up WHERE a >= 2),
    owner AS (SELECT k, arg_min(a, d) AS o FROM up JOIN part ON p_partkey = a WHERE p_size % 3 = 0 GROUP BY k),
    c AS (SELECT p.p_partkey AS k, {_file('p.p_partkey')} AS path, mine.o AS mine, p.p_partkey // 3 AS third, its.o AS its FROM part p LEFT JOIN owner mine ON mine.k = p.p_partkey LEFT JOIN owner its ON its.k = p.p_partkey // 3)
    SELECT path, 1 AS line, path || ':free' || k AS target, 'same_file' AS how FROM c
    UNION ALL SELECT path, 2, {_file('mine')} || ':Part' || mine || '.run', CASE WHEN mine IS NOT NULL THEN 'method' END FROM c
    UNION ALL SELECT path, 3, coalesce({_file('its')} || ':Part' || its || '.run', {_file('third')} || ':Part' || third), CASE WHEN its IS NULL THEN 'class' ELSE 'method' END FROM c
    UNION ALL SELECT path, 4, {_file('k // 4')} || ':Part' || k // 4, 'class' FROM c
    UNION ALL SELECT path, 5, {_file('mine')} || ':Part' || mine || '.run', CASE WHEN mine IS NOT NULL THEN 'method' END FROM c
    UNION ALL SELECT path, 6, {_file('k - 1')} || ':free' || k - 1, 'import' FROM c WHERE k >= 1
    UNION ALL SELECT path, 7, {_file('k // 5')} || ':Part' || k // 5, 'constructor' FROM c UNION ALL SELECT path, 8, {_file('k - 2')} || ':free' || k - 2, 'unique' FROM c WHERE k >= 2""")
def call_strategies(spark, sf_dir):
    """A call of each kind in the class of every part, by the strategy that resolves it."""
    k, text = F.col("k"), lambda c: F.floor(c).cast("string")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size").withColumn("path", F.concat(F.lit("lib/k"), text(k), F.lit(".dart")))
    named = lambda prefix, c: F.concat(F.lit(prefix), text(c))
    none = F.lit(None).cast("string")
    forms = [(named("free", k), none), (F.lit("run"), F.lit("this")), (F.lit("run"), named("part", k / 3)), (F.lit("make"), named("Part", k / 4)), (F.lit("run"), none), (F.when(k >= 1, named("free", k - 1)), none), (named("Part", k / 5), none), (F.when(k >= 2, named("free", k - 2)), none)]
    calls = p.select("path", named("Part", k).alias("caller_class"), F.posexplode(F.array(*[F.struct(n.alias("name"), r.alias("receiver")) for n, r in forms])).alias("line", "c"))
    calls = calls.select("path", (F.col("line") + 1).alias("line"), "c.name", "c.receiver", "caller_class").where("name is not null")
    classes = p.select("path", named("Part", k).alias("name"), F.when(k >= 2, named("Part", k / 2)).alias("extends_class"), F.lit(None).cast("array<string>").alias("mixins"), F.lit(None).cast("array<string>").alias("implements"))
    functions = p.select("path", named("free", k).alias("name"), none.alias("parent_class")).unionByName(p.where("p_size % 3 = 0").select("path", F.lit("run").alias("name"), named("Part", k).alias("parent_class")))
    imported = p.where("k >= 1").select("path", F.concat(F.lit("lib/k"), text(k - 1), F.lit(".dart")).alias("target"))
    return resolve_calls(calls, functions, classes.select("path", "name"), G.hierarchy(classes), imported).select("path", "line", "target", "how")


@query(f"""WITH p AS (SELECT {_PATH} AS path, p_partkey AS k, p_size AS n, {_LONG} AS long FROM part)
    SELECT 'helper' || n AS name, path AS used_in, 5 AS line, 1 AS times, 'Part' || k AS class, 'run' || n AS function FROM p
    UNION ALL SELECT unnest(['c' || n, 'dispose']), path, 9, 1, 'Part' || k, 'dispose' FROM p WHERE long""")
def usage_places(spark, sf_dir):
    s, f = _symbols(spark, sf_dir), _sources(spark, sf_dir)
    return P.usage_places(s, f, P.symbol_spans(s))


@query("""SELECT 'Part' || p_partkey AS name, 'class' AS kind, 'lib/k' || p_partkey || '.dart' AS path, 1 AS line, 8 + CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS line_end FROM part
    UNION ALL SELECT 'go', 'method', 'lib/k' || p_partkey || '.dart', 2, 8 FROM part""".replace("8 + CASE", "9 + CASE"))
def code_block_ends(spark, sf_dir):
    """Blocks of classes and methods of which only the first lines are known."""
    rows = L.lines(_class_files(spark, sf_dir))
    starts = rows.where("text like 'class %'").select("path", "line", F.lit("class").alias("kind"), F.regexp_extract("text", r"^class (\w+)", 1).alias("name")).unionByName(
        rows.where("text like '  void go()%'").select("path", "line", F.lit("method").alias("kind"), F.lit("go").alias("name")))
    return starts.join(X.block_ends(starts, rows), ["path", "line"]).select("name", "kind", "path", "line", "line_end")


# ---- substring joins
_KEYS = "(SELECT DISTINCT substr(md5(CAST(c_custkey AS VARCHAR)), 1, 3) AS key FROM customer)"


@query(f"SELECT key FROM {_KEYS} k WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, key))")
def keys_nowhere(spark, sf_dir):
    """Keys that no document holds, wherever in a word."""
    keys = table(spark, sf_dir, "customer").select(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 3).alias("key")).distinct()
    return keys.join(U.keys_within(table(spark, sf_dir, "documents"), keys), "key", "left_anti")


@query(f"SELECT DISTINCT p_name AS text, key FROM part JOIN (SELECT DISTINCT substr(p_type, 2, 3) AS key FROM part UNION SELECT DISTINCT lower(substr(p_type, 1, 2)) FROM part) ON contains(p_name, key)")
def keys_in_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    keys = p.select(F.substring("p_type", 2, 3).alias("key")).union(p.select(F.lower(F.substring("p_type", 1, 2))))
    return U.pairs_within(p.select(F.col("p_name").alias("text")), keys)


@query("""WITH i AS (SELECT DISTINCT 'src/i' || (p_partkey % 97) || '.ts' AS path, replace(p_name, ' ', '/') AS spec FROM part), f AS (SELECT DISTINCT 'lib/' || replace(p_name, ' ', '/') AS path FROM part UNION SELECT DISTINCT 'lib/w/' || string_split(p_name, ' ')[1] || '.ts' FROM part)
    SELECT i.path, i.spec, f.path AS target FROM i JOIN f ON f.path <> i.path AND (f.path = i.spec OR ends_with(f.path, '/' || i.spec) OR contains(i.spec, regexp_replace(regexp_extract(f.path, '[^/]*$'), '\\.[^.]*$', '')))""")
def loose_import_targets(spark, sf_dir):
    p, name = table(spark, sf_dir, "part"), F.col("p_name")
    imports = p.select(F.concat(F.lit("src/i"), (F.col("p_partkey") % 97).cast("string"), F.lit(".ts")).alias("path"), F.replace(name, F.lit(" "), F.lit("/")).alias("spec"))
    files = p.select(F.concat(F.lit("lib/"), F.replace(name, F.lit(" "), F.lit("/"))).alias("path")).union(p.select(F.concat(F.lit("lib/w/"), F.split(name, " ")[0], F.lit(".ts")))).distinct()
    return loose_targets(imports, files)


# ---- the stored index
@query(_bm25_sql(_DOCS, {"name": 4.0, "comments": 0.3}, ["erly", "oued"], "erly oued", (10, 5, 2), 1, 50))
def bm25_stored_index(spark, sf_dir):
    """An index on disk after three upserts, of which one changes documents, and a removal that the last upsert makes good."""
    d = _docs(spark, sf_dir)
    index = StoredIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    index.upsert(d.where("id % 3 != 0").withColumn("comments", F.concat("comments", F.lit(" erly"))))
    index.upsert(d.where("id % 3 != 2"))
    index.remove(d.where("id % 4 = 1").select("id"))
    index.upsert(d.where("id % 3 = 2 or id % 4 = 1"))
    index.compacted()
    return _top(written(index.search("erly oued", 50)))


# ---- all forms of unfinished code
_UNFINISHED = (
    ("onTap: () {}", "callback"), ("onLongPress: (x) => null,", "callback"), ("onSaved: () => false", "callback"), ("onClick={() => {}}", "callback"), ("onFocus={function (e) {}}", "callback"), ("onChange={() => console.log(e)}", "callback"),
    ("onPressed: () async { print('x'); },", "callback"), ("onClick = { v -> }", "callback"), ("onRefresh = {}", "callback"), ("onClick = { Toast.makeText(a, b, c).show() }", "callback"), ("b.setOnTouchListener(null)", "callback"),
    ("b.setOnClickListener(v -> {})", "callback"), ("b.setOnClickListener(new View.OnClickListener() { @Override public void onClick(View v) {} })", "callback"), ("onTap : null,", "callback"), ("onTap: nullable", None), ("onAnything: () {}", None),
    ("onChange = {}", None), ("onTap: () { go(); }", None), ("final tempUser = 1;", "data"), ("var tempDbName = 1", None), ("List<User> fakeUsers = []", "data"), ("Map<String, int> mockMap = {}", "data"), ("final User fakeUser = x", None),
    ("final mockUser;", None), ("class MockApi {", "data"), ("class Mockups {", None), ("img('https://avatar.iran.liara.run/1')", "data"), ("phone = '+1234567890'", "data"), ("t = 'نص تجريبي'", "data"), ("'12345678'", None),
    ('tools:text="@tools:sample/lorem"', "data"), ('tools:listitem="@layout/row_dummy_item"', "data"), ('tools:listitem="@layout/row"', None), ("throw NotImplementedError()", "widget"), ("// hack: later", "comment"), ("<!-- STUB -->", "comment"), ("Thread.sleep(300)", "async"),
)
_UNFINISHED_ROWS = ", ".join(f"({k}, '{c}')" for k, (_, c) in enumerate(_UNFINISHED) if c)


@query(f"SELECT 'lib/e' || event_id || '.kt' AS path, category FROM events JOIN (VALUES {_UNFINISHED_ROWS}) f(k, category) ON k = event_id % {len(_UNFINISHED)}")
def unfinished_forms(spark, sf_dir):
    """Each form of unfinished code, and near misses, by the event's number."""
    text = F.get(F.array(*[F.lit(t) for t, _ in _UNFINISHED]), (F.col("event_id") % len(_UNFINISHED)).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("lib/e"), F.col("event_id").cast("string"), F.lit(".kt")).alias("path"), F.lit(1).alias("line"), text.alias("text"))
    return A.mockups(rows).select("path", "category").distinct()


# ---- locale files of nations with a key for each sixtieth of their customers
_ENTRIES = """e AS (SELECT CASE WHEN c_nationkey = 0 THEN 'en' ELSE 'x' || chr(CAST(97 + c_nationkey AS INTEGER)) END AS locale, 'k' || c_custkey % 60 AS key, max(c_custkey) AS c FROM customer GROUP BY 1, 2),
    m AS (SELECT 'l10n/app_' || locale || '.arb' AS path, locale, key, c, 'V' || c || ' {a}' || CASE WHEN c % 3 = 0 THEN ' {b}' ELSE '' END AS value FROM e)"""


def _locale_files(spark, sf_dir):
    locale = F.when(F.col("c_nationkey") == 0, "en").otherwise(F.concat(F.lit("x"), F.chr(97 + F.col("c_nationkey"))))
    e = table(spark, sf_dir, "customer").groupBy(locale.alias("locale"), F.concat(F.lit("k"), (F.col("c_custkey") % 60).cast("string")).alias("key")).agg(F.max("c_custkey").alias("c"))
    value = F.concat(F.lit("V"), F.col("c").cast("string"), F.lit(" {a}"), F.when(F.col("c") % 3 == 0, " {b}").otherwise(""))
    meta = F.when(F.col("c") % 2 == 0, F.concat(F.lit(', "@'), "key", F.lit('": {"description": "about '), "key", F.lit('", "placeholders": {"a": {}}}'))).otherwise("")
    entry = F.concat(F.lit('"'), "key", F.lit('": "'), value, F.lit('"'), meta)
    files = e.groupBy("locale").agg(F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("entries"))
    return files.select(F.concat(F.lit("l10n/app_"), "locale", F.lit(".arb")).alias("path"), F.concat(F.lit('{"@@locale": "'), "locale", F.lit('", '), "entries", F.lit("}")).alias("content"))


@query(f"""WITH {_ENTRIES}, b AS (SELECT key, arg_min(path, (locale <> 'en')::INT || path) AS path, arg_min(c, (locale <> 'en')::INT || path) AS c FROM m GROUP BY key)
    SELECT path, key, 'b' AS name FROM b WHERE c % 6 = 0""")
def undeclared_placeholders(spark, sf_dir):
    return T.undeclared_placeholders(_locale_files(spark, sf_dir))


@query(f"""WITH {_ENTRIES}, src AS (SELECT key, value, c FROM m WHERE locale = 'en'), gaps AS (SELECT key, value, c, l.locale FROM src, (SELECT DISTINCT locale FROM m WHERE locale <> 'en') l WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.locale = l.locale AND m.key = src.key))
    SELECT key, value, CASE WHEN c % 2 = 0 THEN 'about ' || key END AS description, CASE WHEN c % 2 = 0 THEN 'a' END AS placeholders, string_agg(locale, ',' ORDER BY locale) AS locales FROM gaps GROUP BY key, value, c""")
def missing_entries(spark, sf_dir):
    return T.missing_entries(_locale_files(spark, sf_dir))


# ---- package lists
@query("SELECT 'pkg_' || p_partkey AS name, '1.' || p_size || '.0' AS version, 'hosted' AS source, 'transitive' AS dependency_type FROM part WHERE p_size % 3 = 1 AND p_partkey % 2 = 0")
def package_filter(spark, sf_dir):
    """Transitive packages of one source, of a lock file for each part."""
    kind = F.element_at(F.array(*map(F.lit, ("direct main", "transitive", "direct dev"))), (F.col("p_size") % 3 + 1).cast("int"))
    source = F.when(F.col("p_partkey") % 2 == 0, "hosted").otherwise("git")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    content = F.concat(F.lit("packages:\n  pkg_"), key, F.lit(':\n    dependency: "'), kind, F.lit('"\n    source: '), source, F.lit('\n    version: "1.'), size, F.lit('.0"\nsdks:\n  dart: "3"\n'))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), key, F.lit("/pubspec.lock")).alias("path"), content.alias("content"))
    return Pk.packages_where(Pk.pubspec_lock(files), "transitive", "hosted")
