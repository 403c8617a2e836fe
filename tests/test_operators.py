"""Operators on small literal tables, with the cases that FIXTURES.md lists."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import paths, tokens
from lodestrata.functions.icu import parse_message
from lodestrata.operators import audit, edits, graph, l10n, lines, resolve, search, spans
from lodestrata.sources import files as file_sources
from lodestrata.sources import packages, store
from lodestrata.streaming import changes


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# ---- tokens, paths
def test_tokenizers(spark):
    texts = ["getHTTPResponse2", "snake_case_name", "Ünïcode_X", "a b1C", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.ascii_tokens("t").alias("a"), tokens.unicode_tokens("t").alias("u"))
    got = df.collect()
    assert got[0]["a"] == ["get", "http", "response2"] and got[0]["u"] == ["gethttpresponse2", "get", "http", "response", "2"]
    assert got[1]["u"] == ["snake_case_name", "snake", "case", "name"] and got[4]["a"] == [] and got[5]["u"] == []
    assert tokens.query_tokens("getHTTPResponse2 get") == ["get", "http", "response2"]
    assert tokens.query_tokens("snake_case", "rs") == ["snake_case", "snake", "case"]


def test_ascii_tokens_equal_query_tokens(spark):
    rng = random.Random(18)
    texts = ["".join(rng.choices("aabcABCC019 _-.\u00e9\u212a\u0130\n", k=rng.randint(0, 40))) for _ in range(3000)] + ["A" * 20000 + "b" * 20000 + "1" * 20000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.ascii_tokens("t").alias("a")).collect()
    assert len(got) == len(texts) and all(list(dict.fromkeys(r["a"])) == tokens.query_tokens(r["t"]) for r in got)


def test_paths(spark):
    df = spark.createDataFrame([("lib/a/../b/./c.dart",), ("../x",), ("a\\b\\C.KT",)], "p string")
    got = df.select(paths.normalized(F.col("p")).alias("n"), paths.extension(paths.posix(F.col("p"))).alias("e"), paths.stem(paths.posix(F.col("p"))).alias("s")).collect()
    assert [r["n"] for r in got] == ["lib/b/c.dart", None, "a/b/C.KT"] and got[2]["e"] == "kt" and got[0]["s"] == "c"
    assert paths.fnv1a64(b"") == "cbf29ce484222325" and paths.fnv1a64(b"a") == "af63dc4c8601ec8c"
    assert spark.createDataFrame([("a",)], "t string").select(paths.content_hash(F.col("t"), "rs").alias("h")).first()["h"] == "af63dc4c8601ec8c"
    import re

    for glob, yes, no in (("**/*.g.dart", "lib/x/a.g.dart", "a.dart"), ("lib/*.dart", "lib/a.dart", "lib/x/a.dart"), ("build/**", "build/a/b", "src/build"), ("a?.ts", "ab.ts", "abc.ts")):
        assert re.match(paths.glob_regex(glob), yes) and not re.match(paths.glob_regex(glob), no)


# ---- search
@pytest.fixture(scope="module")
def symbols(spark):
    data = [("1", "LoginScreen", "lib/login_screen.dart", "StatelessWidget", "shows the login form"), ("2", "HomeScreen", "lib/home.dart", "StatelessWidget", "home"), ("3", "AuthService", "lib/auth.dart", None, "login and logout"), ("4", "AppLoginScreenFactory", "lib/f.dart", None, None)]
    return spark.createDataFrame(data, "id string, name string, path string, superclass string, comments string")


def test_search_orders(symbols):
    for dialect in ("ts", "rs"):
        got = [r["name"] for r in search.search(symbols, "LoginScreen", dialect).collect()]
        assert got[0] == "LoginScreen" and got[1] == "AppLoginScreenFactory"
    assert [r["name"] for r in search.search(symbols, "logout").collect()] == ["AuthService"]
    assert search.search(symbols, "  ").count() == 0 and search.search(symbols.limit(0), "login").count() == 0
    assert [r["name"] for r in search.search(symbols, "ogin", "rs").collect()] == ["LoginScreen", "AppLoginScreenFactory"]
    assert [r["name"] for r in search.symbol_search(symbols, "screen").collect()][0] in ("HomeScreen", "LoginScreen")


def test_signature_ignores_order(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    assert search.index_signature(a) == search.index_signature(a.orderBy(F.desc("path"))) != search.index_signature(a.limit(1))


# ---- lines and spans
def test_line_dialects_and_search(spark):
    f = spark.createDataFrame([("a.dart", "one\r\nTwo\n"), ("b.dart", "two two")], "path string, content string")
    assert lines.lines(f, "rs").count() == 3 and lines.lines(f, "ts").count() == 4
    ls = lines.lines(f)
    assert rows(lines.search_text(ls, "two"), "path", "line") == [("a.dart", 2), ("b.dart", 1)]
    assert rows(lines.search_text(ls, "t[", regex=True), "path") == [] and lines.search_text(ls, "Tw.", True, True).count() == 1
    assert lines.search_text(ls, "two", per_match=True, regex=True).count() == 3
    assert rows(lines.word_references(ls, "two"), "path", "hits") == [("b.dart", 2)]


def test_innermost_span_and_fragment(spark):
    data = [("f", "class", "A", None, 1, 30, 1), ("f", "method", "m", "A", 5, 9, 2), ("f", "function", "g", None, 40, None, 3)]
    s = spark.createDataFrame(data, "path string, kind string, name string, parent string, line int, line_end int, ord int")
    c = spark.createDataFrame([("f", 6), ("f", 12), ("f", 70), ("f", 99)], "path string, at int")
    assert rows(spans.node_at(s, c), "at", "name") == [(12, "A"), (6, "m"), (70, "g")]
    text = spark.createDataFrame([("f", "\n".join(f"l{i}" if i not in (3, 4) else "/// doc" for i in range(1, 60)))], "path string, content string")
    block = lines.code_blocks(s, lines.lines(text), "m").first()["source"]
    assert block == "l5\nl6\nl7\nl8\nl9"
    part = rows(lines.fragment(s, lines.lines(text), "m", context=1), "line", "part")
    assert part == [(10, "after"), (3, "doc"), (4, "doc"), (5, "body"), (6, "body"), (7, "body"), (8, "body"), (9, "body")]


def test_logic_flow(spark):
    body = ["if (x == null) {", "// if", "for (a in b)", "await http.get(u)", "setState(() {})", "} catch (e) {", "return;", "other"]
    f = spark.createDataFrame([("f", "\n".join(body))], "path string, content string")
    ls = lines.lines(f)
    assert [r["kind"] for r in lines.logic_flow(ls).orderBy("step").collect()] == ["validation", "loop", "api_call", "state_update", "error_handling", "return"]
    assert tuple(lines.flow_summary(ls).first())[1:] == (6, 4, 1)


def test_direct_definitions(spark):
    f = spark.createDataFrame([("a", "abstract class Foo {\nenum Bar { x }\nfinal int foo = 1;")], "path string, content string")
    assert rows(lines.direct_definitions(lines.lines(f), "foo"), "kind", "name") == [("class", "Foo"), ("variable", "foo")]


# ---- graph
def test_graph_searches(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("s", "s")], "src string, dst string")
    assert rows(graph.nodes_on_cycles(e), "node") == [("a",), ("b",), ("c",)]
    assert rows(graph.nodes_on_cycles(e, skip_loops=False), "node") == [("a",), ("b",), ("c",), ("s",)]
    two = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "g"), ("x", "y"), ("y", "x"), ("g", "h")], "src string, dst string")
    assert rows(graph.nodes_on_cycles(two), "node") == [(n,) for n in "bcdefxy"]
    assert rows(graph.cycle_list(e), "nodes", "length") == [(["a", "b", "c", "a"], 3)]
    assert rows(graph.cycle_list(e, "rs"), "nodes") == [(["a", "b", "c", "a"],), (["s", "s"],)]
    got = graph.impact(e, "e")
    assert rows(got, "node", "hops") == [("a", 4), ("b", 3), ("c", 2), ("d", 1)]
    reached = graph.bfs(e, spark.createDataFrame([("e",)], "node string"), backwards=True)
    assert {r["node"]: r["chain"] for r in graph.chains(reached).collect()}["b"] == ["e", "d", "c", "b"]
    assert graph.bfs(e, spark.createDataFrame([("zz",)], "node string")).count() == 1
    assert rows(graph.ancestors(spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x")], "child string, parent string")), "node", "ancestor", "depth")[:2] == [("x", "y", 1), ("x", "z", 2)]


def test_deep_chain(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(14)], "src string, dst string")
    assert graph.impact(e, "n14").agg(F.max("hops")).first()[0] == 14


def test_layers(spark):
    p = ["lib/domain/a.dart", "lib/bloc/b.dart", "lib/services/c.dart", "lib/x.dart", "LIB/Utils/d.dart", "lib\\data\\e.dart"]
    got = spark.createDataFrame([(x,) for x in p], "p string").select(audit.layer_of(F.col("p"), "rs").alias("r"), audit.layer_of(F.col("p"), "ts").alias("t")).collect()
    assert [r["r"] for r in got] == ["domain", "presentation", "other", "other", "core", "data"]
    assert [r["t"] for r in got] == ["domain", "domain", "data", "other", "core", "data"]


# ---- resolution
def test_import_resolution(spark):
    f = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b.ts", "src/dir/index.ts", "lib/x.dart", "lib/sub/y.dart", "app/com/example/Main.kt", "src/util/z.tsx")], "path string")
    cases = [
        ("src/a.ts", "./b", "src/b.ts"), ("src/a.ts", "./b.js", "src/b.ts"), ("src/a.ts", "./dir", "src/dir/index.ts"), ("src/a.ts", "vscode", None), ("src/a.ts", "node:fs", None),
        ("lib/x.dart", "package:me/sub/y.dart", "lib/sub/y.dart"), ("lib/x.dart", "package:other/q.dart", None), ("lib/x.dart", "sub/y.dart", "lib/sub/y.dart"), ("lib/x.dart", "dart:io", None),
        ("app/com/example/Main.kt", "com.example.Main", "app/com/example/Main.kt"), ("src/a.ts", "../../../etc", None), ("src/a.ts", "@/util/z", "src/util/z.tsx"),
    ]
    asked = spark.createDataFrame([(a, b) for a, b, _ in cases], "path string, spec string")
    got = {(r["path"], r["spec"]): r["target"] for r in resolve.resolve_imports(asked, f, "me", (("@/", "src/"),)).collect()}
    assert got == {(a, b): t for a, b, t in cases}
    d = asked.select("path", "spec", resolve.dart_target(F.col("path"), F.col("spec"), F.lit("me")).alias("t"))
    assert {r["spec"]: r["t"] for r in d.where("path = 'lib/x.dart'").collect()} == {"package:me/sub/y.dart": "lib/sub/y.dart", "package:other/q.dart": None, "sub/y.dart": "lib/sub/y.dart", "dart:io": None}


def test_call_resolution(spark):
    fn = [("src/a.ts", "run", "Alpha"), ("src/a.ts", "build", "Alpha"), ("src/a.ts", "helper", None), ("src/b.ts", "dispose", "Base"), ("src/b.ts", "buildFullIndex", "IndexManager"), ("src/b.ts", "build", "IndexManager"), ("src/b.ts", "fromB", None), ("src/b.ts", "helper", None), ("src/c.ts", "build", "Other"), ("src/c.ts", "unique", None)]
    functions = spark.createDataFrame(fn, "path string, name string, parent_class string")
    classes = spark.createDataFrame([("src/a.ts", "Alpha"), ("src/b.ts", "Base"), ("src/b.ts", "IndexManager"), ("src/c.ts", "Other")], "path string, name string")
    ancestry = spark.createDataFrame([("Alpha", "Alpha", 0), ("Alpha", "Base", 1), ("Base", "Base", 0), ("IndexManager", "IndexManager", 0), ("Other", "Other", 0)], "node string, ancestor string, depth int")
    imported = spark.createDataFrame([("src/a.ts", "src/b.ts")], "path string, target string")
    cases = [
        ("run", "this", "Alpha", "src/a.ts:Alpha.run"), ("dispose", "this", "Alpha", "src/b.ts:Base.dispose"), ("dispose", "super", "Alpha", "src/b.ts:Base.dispose"), ("run", "super", "Alpha", None),
        ("buildFullIndex", "indexManager", "Alpha", "src/b.ts:IndexManager.buildFullIndex"), ("missing", "IndexManager", "Alpha", "src/b.ts:IndexManager"), ("helper", None, "Alpha", "src/a.ts:helper"),
        ("fromB", None, "Alpha", "src/b.ts:fromB"), ("unique", None, None, "src/c.ts:unique"), ("Other", None, None, "src/c.ts:Other"), ("build", None, None, None), ("x", "unknown", None, None),
    ]
    calls = spark.createDataFrame([("src/a.ts", i, n, r, c) for i, (n, r, c, _) in enumerate(cases)], "path string, line int, name string, receiver string, caller_class string")
    got = {r["line"]: r["target"] for r in resolve.resolve_calls(calls, functions, classes, ancestry, imported).collect()}
    assert [got[i] for i in range(len(cases))] == [t for *_, t in cases]


# ---- audits
def test_hardcoded_values(spark):
    f = [
        ("a.dart", "Text('Hello', x)\n// Text('no')\n/* Text('no')\n Text('no')\n*/ Colors.red\nColors.transparent; Color(0xFF112233)\nimport 'Colors.blue';"),
        ("l.xml", '<TextView android:text="Hi there" android:textColor="#FF112233"/>\n<!-- android:text="no no" -->\n<TextView android:text="@string/x"/>'), ("s.tsx", "style={{ color: '#112233' }}\n// color: '#445566'"),
    ]
    got = rows(audit.hardcoded_values(lines.lines(spark.createDataFrame(f, "path string, content string"))), "path", "line", "type", "value")
    assert got == sorted([("a.dart", 1, "hardcoded_text", "Hello"), ("a.dart", 5, "hardcoded_color", "Colors.red"), ("a.dart", 6, "hardcoded_color", "Color(0xFF112233)"), ("l.xml", 1, "hardcoded_text", "Hi there"), ("l.xml", 1, "hardcoded_color", "#FF112233"), ("s.tsx", 1, "hardcoded_color", "#112233")], key=str)


def test_mockups(spark):
    t = "// TODO: later\nonPressed: () {},\nonTap: null,\nreturn Placeholder();\nfinal mockUsers = [];\nclass FakeApi {}\n'John Doe'\n\n\n\nawait Future.delayed(x);\n\n\n\nTimer t;\nawait Future.delayed(y);"
    f = spark.createDataFrame([("lib/a.dart", t), ("test/a_test.dart", "final mockUsers = [];")], "path string, content string")
    got = audit.mockups(lines.lines(f))
    assert rows(got, "path", "line", "category") == sorted([("lib/a.dart", n, c) for n, c in ((1, "comment"), (2, "callback"), (3, "callback"), (4, "widget"), (5, "data"), (6, "data"), (7, "data"), (11, "async"))], key=str)
    assert {r["category"]: r["n"] for r in audit.category_breakdown(got).collect()} == {"comment": 1, "callback": 2, "widget": 1, "data": 3, "async": 1, "input": 0}
    assert rows(audit.rule_hits(lines.lines(f)), "line", "mark") == [(1, "TODO"), (2, "onPressed: () {}"), (4, "Placeholder(")]


def test_mockup_forms(spark):
    hit = {
        "callback": ["onTap: () {}", "onClick={() => {}}", "onPressed: () async { print('x'); },", "button.setOnClickListener { }", "onClick = { v -> }", "setOnClickListener { Log.d(TAG) }", "onPressed : null,"],
        "widget": ["throw UnimplementedError();", "throw new UnsupportedOperationException(x)", "TODO('later')"],
        "data": ["val dummyUser = 1", "final List<User> fakeUsers = []", "object MockApi", "img('https://picsum.photos/200')", 'name = "Jane Doe"', "'Lorem ipsum dolor'"],
        "comment": ["x(); // fixme later", "<!-- HACK -->"], "async": ["Thread.sleep(300)"],
    }
    clean = ["onTap: () { go(); }", "final mockupTool = 1", "// the todo list", "onPressed: save", "final users = load()", "callback(delayed)", "onTap: handler"]
    texts = [(c, t) for c, ts in hit.items() for t in ts] + [(None, t) for t in clean]
    f = spark.createDataFrame([(f"lib/f{k}.kt", t) for k, (_, t) in enumerate(texts)], "path string, content string")
    got = {r["path"]: r["category"] for r in audit.mockups(lines.lines(f)).collect()}
    assert [got.get(f"lib/f{k}.kt") for k in range(len(texts))] == [c for c, _ in texts]


def test_leaks_and_assets(spark):
    f = [("a.dart", "class S extends State<W> {\n final TextEditingController name = TextEditingController();\n late ScrollController s;\n void dispose() { s.dispose(); }\n}"), ("b.dart", "x = FocusNode();"), ("c.dart", "load('assets/a.png'); icon('b.png');")]
    files = spark.createDataFrame(f, "path string, content string")
    assert rows(audit.leak_candidates(files), "path", "name", "type") == [("a.dart", "name", "TextEditingController")]
    assets = spark.createDataFrame([("assets/a.png", 1), ("assets/img/b.png", 2), ("assets/c.png", 3)], "path string, size int")
    assert rows(audit.unused_assets(assets, files), "path") == [("assets/c.png",)]


def test_trees(spark):
    n = [("f", 0, None, 0, 0, "Col"), ("f", 1, 0, 1, 1, "Row"), ("f", 2, 1, 2, 2, "Text"), ("f", 3, 0, 3, 1, "Icon"), ("g", 0, None, 0, 0, "Col"), ("g", 1, 0, 1, 1, "Icon"), ("g", 2, 0, 2, 1, "Row"), ("g", 3, 2, 3, 2, "Text")]
    nodes = spark.createDataFrame(n, "path string, node_id int, parent_id int, ord int, depth int, name string")
    assert rows(audit.duplicate_subtrees(nodes, 2, "rs"), "signature", "n") == [("Row(Text)", 2)]
    assert rows(audit.duplicate_subtrees(nodes, 3, "ts"), "signature", "size", "n") == [("Col(Icon,Row(Text))", 4, 2)]
    assert rows(audit.depth_violations(nodes, 2), "path", "depth") == [("f", 3), ("g", 3)]


def test_diagnostics(spark):
    t = ["   error • Undefined name • lib/main.dart:10:5 • undefined_identifier", "   info - Prefer const - lib/a.dart:1:2 - prefer_const", "src/a.ts(3,7): error TS2345: Argument of type", "app/Main.java:12: error: cannot find symbol", "Analyzing project..."]
    d = audit.diagnostics(spark.createDataFrame([(x,) for x in t], "text string"))
    assert rows(d, "severity", "file", "line", "col") == sorted([("error", "lib/main.dart", 10, 5), ("info", "lib/a.dart", 1, 2), ("error", "src/a.ts", 3, 7), ("error", "app/Main.java", 12, 1)], key=str)


# ---- localisation
def test_translations(spark):
    f = [("l/app_en.arb", json.dumps({"@@locale": "en", "hello": "Hello {name}", "bye": "Bye", "@bye": {"x": 1}})), ("l/app_ar.arb", json.dumps({"hello": "مرحبا"})), ("l/bad.arb", "{")]
    files = spark.createDataFrame(f, "path string, content string")
    t = l10n.translations(files).cache()
    assert rows(t, "locale", "key") == [("ar", "hello"), ("en", "bye"), ("en", "hello")] and rows(l10n.unreadable(files), "path") == [("l/bad.arb",)]
    assert rows(l10n.missing_keys(t), "path", "key") == [("l/app_ar.arb", "bye")]
    assert rows(l10n.missing_payload(t), "key", "locales") == [("bye", "ar")]
    for dialect in ("rs", "ts"):
        issues = rows(l10n.message_issues(t, dialect), "path", "key", "issue")
        assert ("l/app_ar.arb" if dialect == "ts" else "l/app_en.arb", "hello", "placeholder_mismatch") in issues
    code = spark.createDataFrame([("lib/a.dart", "S.of(c).hello"), ("lib/generated/l10n.dart", "bye")], "path string, content string")
    assert rows(l10n.unused_keys(t, code), "key") == [("bye",)]
    u = spark.createDataFrame([("en", "bye", "Goodbye"), ("ar", "bye", "x")], "locale string, key string, value string")
    assert rows(l10n.with_translations(t, u).where("key = 'bye'"), "locale", "value") == [("ar", "x"), ("en", "Goodbye")]
    with pytest.raises(ValueError):
        l10n.with_translations(t, u, l10n.unreadable(files))
    assert l10n.without_key(t, "hello").count() == 1 and l10n.with_locale(t, "fr", "l/app_fr.arb").where("locale = 'fr'").count() == 2
    assert "String hello(Object name) => 'Hello $name';" in {r["locale"]: r["source"] for r in l10n.generated_source(t).collect()}["en"]
    assert rows(l10n.key_lines(spark.createDataFrame([("p", '{\n "a": "x",\n "b": "y"\n}')], "path string, content string"), spark.createDataFrame([("p", "b")], "path string, key string")), "line") == [(3,)]


@pytest.mark.parametrize(
    "message, args, kinds",
    [
        ("{count, plural, one{1 item of {user}} other{{count} items}}", ["count", "user"], []), ("{gender, select, male{he} other{they}}", ["gender"], []), ("{n, plural, one{x}}", ["n"], ["other"]),
        ("Hello {name", ["name"], ["syntax"]), ("Hello name}", [], ["syntax"]), ("Hi {}", [], ["syntax"]), ("quoted '{' here", [], []), ("it''s {x}", ["x"], []), ("{price, number, currency}", ["price"], []), ("{n, plural}", ["n"], ["syntax"]),
    ],
)
def test_icu(message, args, kinds):
    a, e = parse_message(message)
    assert a == args and [k for k, _ in e] == kinds


# ---- edits
def test_edits(spark):
    df = spark.createDataFrame([("a", "one two\r\nthree"), ("b", "x x"), ("c", "$1 y")], "path string, content string")
    r = {x["path"]: x for x in edits.replaced(df, "two\nthree", "2\n3").collect()}
    assert r["a"]["content"] == "one 2\r\n3" and r["b"]["error"] == "not found"
    r = {x["path"]: x for x in edits.replaced(df, "x", "$0").collect()}
    assert r["b"]["error"] == "found 2 times" and r["b"]["content"] == "x x"
    assert edits.replaced(df, "x", "", replace_all=True).where("path = 'b'").first()["content"] == " "
    assert edits.replaced(df, "x", "z", expected=2).where("path = 'b'").first()["content"] == "z z"
    t = spark.createDataFrame([("a", "1\n2\n3\n4")], "path string, content string")
    assert edits.lines_replaced(t, 2, 3, "x").first()["content"] == "1\nx\n4" and edits.lines_replaced(t, 2, 9, "x").first()["error"] == "outside the file"
    assert edits.lines_replaced(t, 2, 2, "x", guard="7").first()["error"] == "guard not found" and edits.lines_replaced(t, 1, 4, "").first()["content"] == ""
    assert rows(edits.written_files(t, spark.createDataFrame([("a", "n"), ("z", "m")], "path string, content string")), "path", "content") == [("a", "n"), ("z", "m")]


# ---- sources
def test_file_scan(spark, tmp_path):
    for p, c in (("lib/a.dart", "class A {}"), ("lib/x.g.dart", "gen"), ("build/b.dart", "no"), (".git/c.dart", "no"), ("l10n/app_en.arb", "{}"), ("ios/l10n/app_de.arb", "{}"), ("node_modules/x/app_fr.arb", "{}"), ("out/app_it.arb", "{}"), ("pubspec.yaml", "name: x"), ("readme.md", "# x")):
        f = tmp_path / "proj" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(c)
    root = str(tmp_path / "proj")
    assert rows(file_sources.scan(spark, root, exclude=("**/*.g.dart",)), "path", "content") == [("lib/a.dart", "class A {}")]
    assert rows(file_sources.locale_files(spark, root), "path") == [("l10n/app_en.arb",)]
    every = file_sources.scan(spark, root, ())
    assert file_sources.project_mode(every) == "flutter" and file_sources.under(every, "lib").count() == 2
    cache = tmp_path / "cache.json"
    cache.write_text(json.dumps({"dartFiles": {"a.dart": {"x": 1}, "b.dart": "bad"}}))
    assert rows(file_sources.json_cache(spark, str(cache)), "path") == [("a.dart",)]


def test_packages(spark):
    lock = 'packages:\n  http:\n    dependency: "direct main"\n    source: hosted\n    version: "1.2.0"\n  meta:\n    dependency: transitive\n    source: hosted\n    version: "1.9.1"\nsdks:\n  dart: x\n'
    npm = json.dumps({"packages": {"": {"version": "0"}, "node_modules/a": {"version": "1", "dev": True}, "node_modules/a/node_modules/b": {"version": "2"}}})
    yaml = "name: x\ndependencies:\n  http: ^1.0.0\n  any_one:\n    sdk: flutter\ndev_dependencies:\n  test: any\n"
    gradle = "dependencies {\n implementation 'a.b:c:1.0'\n testImplementation(libs.junit)\n implementation 'a.b:c:2.0'\n}\n"
    f = spark.createDataFrame([("pubspec.lock", lock), ("package-lock.json", npm), ("pubspec.yaml", yaml), ("app/build.gradle", gradle), ("package.json", '{"dependencies":{"z":"1"}}')], "path string, content string")
    assert rows(packages.pubspec_lock(f), "name", "version", "dependency_type") == [("http", "1.2.0", "direct main"), ("meta", "1.9.1", "transitive")]
    assert rows(packages.package_lock(f), "name", "version", "dependency_type") == [("a", "1", "direct dev")]
    assert rows(packages.package_json(f), "name", "version") == [("z", "1")]
    assert rows(packages.pubspec_sections(f), "name", "version", "dependency_type") == [("any_one", "any", "direct main"), ("http", "^1.0.0", "direct main"), ("test", "any", "direct dev")]
    assert rows(packages.gradle(f), "name", "version", "dependency_type") == [("a.b:c", "1.0", "direct main"), ("libs.junit", "any", "direct dev")]
    assert packages.all_packages(f).count() == 2 and packages.manifest_warnings(packages.pubspec_sections(f)).count() == 2


def test_store(spark):
    t = spark.createDataFrame([("a", 1, "h1"), ("b", 1, "h2")], "path string, ts int, hash string")
    c = spark.createDataFrame([("a", 2, "h3"), ("c", 1, "h4"), ("b", 0, "old")], "path string, ts int, hash string")
    assert rows(store.upserted(t, c, ["path"], ["ts"]), "path", "hash") == [("a", "h3"), ("b", "h2"), ("c", "h4")]
    assert rows(store.changed(t, c), "path", "change") == [("a", "modified"), ("b", "modified"), ("c", "added")]
    assert store.point_lookup(t, "a", "h9").count() == 0 and store.pruned(t, c.where("path = 'a'")).count() == 1


# ---- streams
def _events(spark, spec):
    base = datetime(2024, 1, 1)
    return spark.createDataFrame([(k, base + timedelta(milliseconds=ms)) for k, ms in spec], "path string, ts timestamp")


def test_throttle_batch_equals_stream(spark, tmp_path):
    spec = [("a", 0), ("a", 119), ("a", 120), ("a", 200), ("a", 239), ("a", 240), ("a", 1000), ("b", 5), ("b", 60)]
    batch = rows(changes.throttled(_events(spark, spec), ["path"]).select("path", F.unix_millis("at").alias("t")), "path", "t")
    base = 1704067200000
    assert batch == [("a", base), ("a", base + 120), ("a", base + 240), ("a", base + 1000), ("b", base + 5)]
    src = tmp_path / "in"
    src.mkdir()
    (src / "x.json").write_text("\n".join(json.dumps({"path": k, "op": "m", "ts": (datetime(2024, 1, 1) + timedelta(milliseconds=ms)).isoformat()}) for k, ms in spec))
    stream = changes.throttled_stream(changes.file_changes(spark, str(src)), "path")
    q = stream.writeStream.format("memory").queryName("throttle_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("throttle_out"), "key", "t") == batch


def test_debounce_and_single_flight(spark):
    d = changes.debounced(_events(spark, [("a", 0), ("a", 299), ("a", 700), ("b", 0)]), ["path"])
    assert rows(d, "path", "n") == [("a", 1), ("a", 2), ("b", 1)]
    runs = changes.single_flight(_events(spark, [("x", 0), ("x", 100), ("x", 150), ("x", 5000)]), 1000)
    assert [b - a for a, b in runs] == [1000] * 3 and runs[1][0] == runs[0][1]


def test_incremental(spark, tmp_path):
    base = datetime(2024, 1, 1)
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    c = spark.createDataFrame([("a", "Modified", "1", base), ("b", "Modified", "3", base), ("b", "Removed", None, base + timedelta(1)), ("c", "Modified", "9", base)], "path string, op string, hash string, ts timestamp")
    assert rows(changes.incremental(stored, c), "path", "action") == [("a", "skip"), ("b", "delete"), ("c", "upsert")]
    ev = changes.file_events(spark.createDataFrame([("a.dart", "create"), ("b.txt", "create"), ("c.kt", "remove")], "path string, op string"))
    assert rows(ev, "path", "op") == [("a.dart", "Modified"), ("c.kt", "Removed")]
    src = tmp_path / "in"
    src.mkdir()
    (src / "x.json").write_text("\n".join(json.dumps({"path": p, "op": "Modified", "ts": "2024-01-01T00:00:00", "hash": h}) for p, h in (("a", "1"), ("z", "5"))))
    done = []
    q = changes.maintain(spark.readStream.schema("path string, op string, ts timestamp, hash string").json(str(src)), lambda: stored, lambda work, n: done.extend(r["path"] for r in work.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert done == ["z"]


# ---- flows, loose matches, reports
def test_flows_and_radius(spark):
    calls = spark.createDataFrame([("f:A.build", "f:A.load"), ("f:A.load", "g:get"), ("h:main", "g:get"), ("x:y", "z:w")], "src string, dst string")
    changed = spark.createDataFrame([("g:get",)], "node string")
    functions = spark.createDataFrame([("f", "build", "A"), ("f", "load", "A"), ("g", "get", None), ("h", "main", None)], "path string, name string, parent_class string")
    classes = spark.createDataFrame([("A", "StatelessWidget")], "name string, extends_class string")
    entries = graph.named_entry_points(functions, classes)
    assert rows(entries, "node") == [("f:A.build",), ("h:main",)]
    assert [r["flow"] for r in graph.impact_flows(calls, changed, entries).collect()] == ["h:main -> g:get", "f:A.build -> f:A.load -> g:get"]
    derived = spark.createDataFrame([("B", "g:get")], "src string, dst string")
    assert rows(graph.impact_radius(calls, derived, changed, 1), "node") == [("B",), ("f:A.load",), ("h:main",)]
    assert graph.mermaid(derived).first()["diagram"] == 'graph LR\n  B["B"] --> g_get["g:get"]'


def test_loose_targets_usages_and_context(spark):
    f = spark.createDataFrame([("lib/a.dart", "class Foo {}\nFoo x;"), ("lib/b.dart", "Foo y = Foo();")], "path string, content string")
    i = spark.createDataFrame([("lib/b.dart", "a.dart"), ("lib/b.dart", "pkg/a_helper"), ("lib/b.dart", "zzz")], "path string, spec string")
    assert rows(resolve.loose_targets(i, f), "spec", "target") == [("a.dart", "lib/a.dart"), ("pkg/a_helper", "lib/a.dart")]
    from lodestrata.parse import tables

    u = tables.usages(tables.parsed(f), f).where("name = 'Foo'")
    assert rows(u, "used_in", "times") == [("lib/a.dart", 1), ("lib/b.dart", 2)]
    resolved = spark.createDataFrame([("lib/c.dart", "lib/a.dart")], "path string, target string")
    assert ("lib/c.dart",) in rows(resolve.propagate_usage(u, resolved), "used_in")
    ls = lines.lines(f)
    assert lines.with_context(ls).where("path = 'lib/a.dart' and line = 1").first()["context"] == "class Foo {}\nFoo x;"
    assert rows(lines.direct_calls(ls, "foo"), "path", "name") == [("lib/b.dart", "Foo")]
    names = spark.createDataFrame([("Foo",), ("Bar",)], "name string")
    d = spark.createDataFrame([("Foo", "b", 1), ("Foo", "a", 9)], "name string, path string, line int")
    assert rows(resolve.first_definition(names, d), "name", "def_path") == [("Bar", None), ("Foo", "a")]


def test_reports(spark):
    s = spark.createDataFrame([("x", "class", "A"), ("y", "class", "A"), ("y", "class", "B"), ("x", "enum", "E")], "engine string, metric string, name string")
    assert rows(audit.parity_matrix(s, ["x", "y"]), "metric", "x", "y") == [("class", 1, 2), ("enum", 1, 0)]
    assert rows(audit.only_in(s, "y", "x"), "name") == [("B",)]
    g = spark.createDataFrame([(" M lib/a.dart",), ("R  old.kt -> new.kt",), ("?? x y.ts",), ("lib/b.dart",)], "text string")
    assert rows(file_sources.porcelain_paths(g), "path") == [("lib/a.dart",), ("lib/b.dart",), ("new.kt",), ("x y.ts",)]


def test_second_dialect(spark):
    fields = spark.createDataFrame([("a", "A", "timer", "Timer"), ("a", "A", "myController", None), ("a", "A", "n", "int"), ("b", "B", "sub", "StreamSubscription<int>")], "path string, parent string, name string, type string")
    methods = spark.createDataFrame([("a", "A", "dispose"), ("b", None, "close")], "path string, parent string, name string")
    files = spark.createDataFrame([("a", "timer?.x(); this.myController . dispose();"), ("b", "sub.cancel();")], "path string, content string")
    assert {(r["name"], r["has_release"]) for r in audit.leaking_fields(fields, methods, files).collect()} == {("timer", True), ("sub", False)}
    edges = spark.createDataFrame([("lib/domain/a", "lib/metadata/x"), ("domain/a", "x/Data"), ("lib/core/a", "lib/pages/b")], "src string, dst string")
    assert {(r["src"], r["forbidden"]) for r in audit.segment_violations(edges).collect()} == {("domain/a", "data"), ("lib/core/a", "pages")}
    assets = spark.createDataFrame([(f"assets/{n}", 1) for n in ("picture.png", "ab.png", "long_name.svg", "note.txt")], "path string, size int")
    code = spark.createDataFrame([("lib/a.dart", "use('my_picture_2');\nx('ab.pn');"), ("test/a.dart", "long_name")], "path string, content string")
    found = audit.declared_assets(assets, code)
    assert found.count() == 3 and {r["path"] for r in audit.unnamed_assets(found, code).collect()} == {"assets/ab.png", "assets/long_name.svg"}
    times = spark.createDataFrame([("k", None), ("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:00:00.05")], "key string, ts string")
    assert changes.throttled(times, ["key"]).count() == 1


def test_project_files(spark):
    text = "analyzer:\n  exclude:\n    - '**/*.g.dart'\n  strong: true\n    - 'lib/kept/**'\nother:\n  exclude:\n    - lib/**\n"
    f = spark.createDataFrame([("analysis_options.yaml", text), ("lib/a.g.dart", ""), ("lib/kept/b.dart", ""), ("pubspec.yaml", "name: x\ndependencies:\n  a: any\n  b: ^1\n")], "path string, content string")
    assert rows(file_sources.analysis_excludes(f), "line", "glob") == [(3, "**/*.g.dart")]
    assert rows(file_sources.without_excluded(f), "path") == [("analysis_options.yaml",), ("lib/kept/b.dart",), ("pubspec.yaml",)]
    assert file_sources.without_excluded(f.where("path != 'analysis_options.yaml'")).count() == 3
    assert rows(packages.manifest_report(f), "warning", "name") == sorted([("any version", "a"), ("no description", None), ("no sdk constraint", None)], key=str)
    with pytest.raises(ValueError):
        store.counted({"t": f}, "u")
    m = store.metadata_set(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), spark.createDataFrame([("b", "3")], "key string, value string"))
    assert rows(store.metadata_get(m, "a", "b", "c"), "key", "value") == [("a", "1"), ("b", "3")]
    old = spark.createDataFrame([("a", '{\r\n\t"x": 1\r\n}'), ("b", "plain")], "path string, content string")
    new = spark.createDataFrame([("a", '{\n  "x": {\n    "y": "  two"\n  }\n}\n'), ("c", "{}\n")], "path string, content string")
    assert {r["path"]: r["content"] for r in edits.rewritten(old, new).collect()} == {"a": '{\r\n\t"x": {\r\n\t\t"y": "  two"\r\n\t}\r\n}', "a.bak": '{\r\n\t"x": 1\r\n}', "b": "plain", "c": "{}\n"}


def test_message_branches(spark):
    from lodestrata.functions.icu import branches_of

    assert branches_of("a {n, plural, other{x}}") is None and branches_of("{n}") is None
    assert branches_of(" {n, plural, one {a {b {c}}} other{} one{z}}") == ("n", "plural", {"one": "z", "other": ""})
    assert branches_of("{n, select, a{x} b") == ("n", "select", {"a": "x"})
    f = spark.createDataFrame([("l/intl_en.arb", '{"n": "{n, plural, one{a}}", "@n": {"placeholders": {"k": {}, "n": {"type": "int"}}}, "g": "{s, gender, male{he\'s}}"}')], "path string, content string")
    got = {r["key"]: r["member"].splitlines() for r in l10n.message_members(f).collect()}
    assert got["n"][:5] == ["  String n(int n, String k) {", "    return Intl.plural(", "      n,", "      one: 'a',", "      other: 'a',"]
    assert got["g"][1:4] == ["    return Intl.gender(", "      s,", "      male: 'he\\'s',"]
    with pytest.raises(ValueError):
        l10n.without_locale(f, "en")
    with pytest.raises(ValueError):
        l10n.added_locale_path(f, "en")
    assert l10n.added_locale_path(f.limit(0), "de").first()["path"] == "lib/l10n/intl_de.arb"


def test_reports_by_mode(spark):
    b = [("a.dart", k, f"f{k}", "C" if k else None, "method", "h", 90) for k in range(3)] + [(f"{c}.dart", 1, "g", None, "function", "h", 90) for c in "bc"] + [("z", 1, "z", None, "function", None, None)]
    got = audit.duplicate_warnings(spark.createDataFrame(b, "path string, line int, name string, parent string, type string, body_hash string, body_length int"))
    one = {(r["scope"], r["path"], r["line"]): (r["n"], r["others"]) for r in got.collect()}
    assert len(one) == 8 and one["project", "c.dart", 1] == (5, "f0 in a.dart, f1 in a.dart, f2 in a.dart")
    assert one["file", "a.dart", 1] == (3, "f0 (line 0), C.f2 (line 2)")
    e = spark.createDataFrame([("k", 0, "Modified"), ("k", 100, "Removed"), ("k", 200, "Modified"), ("k", 500, "Modified"), ("j", 0, "Modified"), ("k", None, "Modified")], "k string, t long, op string").withColumn("ts", F.timestamp_millis("t"))
    for span in (150, 86_400_000):  # spans of time cut the events of a key, not the results
        assert rows(changes.debounced_changes(e, ["k"], span_ms=span), "k", "at", "op") == sorted([("k", 100, "Removed"), ("k", 500, "Modified"), ("k", 800, "Modified"), ("j", 300, "Modified")], key=str)
    none = spark.createDataFrame([], "severity string, file string")
    assert [audit.diagnostics_report(none, code).first()["success"] for code in (0, 1, None)] == [True, False, False]
    delay = spark.createDataFrame([("lib/pages/a.dart", 1, "await Future.delayed(x);"), ("lib/a.dart", 1, "await Future.delayed(x);")], "path string, line int, text string")
    assert rows(audit.mockups(delay, True), "path") == [("lib/pages/a.dart",)]


def test_users_of_one_element_are_its_usages(spark):
    """Counted by file before they meet: the same rows as from all pairs, with several definitions in a file, and no broadcast of definitions or uses."""
    from lodestrata.parse import tables

    files = [("a.dart", "void foo() { foo(); }\nclass A { void foo() {} }\n"), ("b.dart", "foo() {}\nvoid go() { foo(); foo(); }\n// foo\n"), ("c.dart", "void go() { foo(1); food(); }\n"), ("d.dart", "class Foo { void foo() {} }\n")]
    f = spark.createDataFrame(files, "path string, content string")
    s = tables.parsed(f).cache()
    for name, kind, parent in (("foo", "function", None), ("foo", "function", "A"), ("Foo", "class", None), ("go", "function", None), ("none", "function", None)):
        want = sorted(map(tuple, tables.users_of(s, tables.usages(s, f), name, kind, parent).collect()))
        got = tables.users_in(s, f, name, kind, parent)
        assert sorted(map(tuple, got.collect())) == want
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_element_users_writes_only_what_has_the_name(spark, monkeypatch):
    """Symbols of other names are neither parsed nor written, and a written result repeats few paths near each other."""
    from lodestrata.parse import tables
    from lodestrata.plans import dialect_queries

    kept = []
    monkeypatch.setattr(dialect_queries, "written", lambda df, name: kept.append(df.cache()) or kept[-1])
    dialect_queries.element_users(spark, "/root/testdata/sf0.01")
    assert kept and {r["name"] for r in kept[0].select("name").distinct().collect()} == {"helper7"}
    files = spark.range(2000).selectExpr("concat('f', id, '.dart') path", "'void foo() {}\\nvoid go() { foo(); }\\n' content")
    s = spark.range(2000).selectExpr("concat('f', id, '.dart') path", "'function' kind", "'foo' name", "1 line", "cast(null as string) parent")
    got = [r["def_path"] for r in tables.users_in(s, files, "foo", "function").limit(1000).collect()]
    assert len(set(got)) < 100


def test_usage_counts_never_broadcast(spark):
    from lodestrata.parse import tables

    f = spark.createDataFrame([("a.dart", "void foo() {}\n"), ("b.dart", "void go() { foo(); }\n")], "path string, content string")
    counts = tables.usage_counts(tables.parsed(f).cache(), f)
    assert sorted(map(tuple, counts.collect())) == [("function", "foo", "a.dart", 1), ("function", "go", "b.dart", 0)]
    assert "Broadcast" not in counts._jdf.queryExecution().executedPlan().toString()


def test_files_of_a_small_table_are_parsed_by_many_tasks(spark):
    from lodestrata.plans import source_queries, structure_queries

    for made in (source_queries._sources, structure_queries._class_files):
        assert made(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_calls_and_imports_resolve_without_a_broadcast(spark):
    """Rows made of a small table look small enough for a broadcast, which the driver would hold."""
    from lodestrata.operators import resolve

    calls = spark.createDataFrame([("a", 1, "f", None, "A"), ("b", 1, "f", None, None), ("b", 2, "g", "this", "A")], "path string, line int, name string, receiver string, caller_class string")
    functions = spark.createDataFrame([("a", "f", None), ("c", "g", "A")], "path string, name string, parent_class string")
    classes, own = spark.createDataFrame([("c", "A")], "path string, name string"), spark.createDataFrame([("A", "A", 0)], "node string, ancestor string, depth int")
    imported = spark.createDataFrame([("b", "a")], "path string, target string")
    got = resolve.resolve_calls(calls, functions, classes, own, imported)
    assert sorted((r["path"], r["line"], r["target"], r["how"]) for r in got.collect()) == [("a", 1, "a:f", "same_file"), ("b", 1, "a:f", "import"), ("b", 2, "c:A.g", "method")]
    files = spark.createDataFrame([("lib/a.dart",)], "path string")
    found = resolve.resolve_imports(spark.createDataFrame([("lib/b.dart", "a.dart")], "path string, spec string"), files)
    assert found.first()["target"] == "lib/a.dart"
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_tool_search_without_a_limit(spark):
    """All hits where no limit is given, from symbols and from lines."""
    from lodestrata.operators import search
    from lodestrata.parse import tables

    f = spark.createDataFrame([(f"p{i}.dart", f"class Part{i} {{\n}}\nvoid go() {{ part{i}(); }}\n") for i in range(60)], "path string, content string")
    s = tables.parsed(f)
    for direct in (False, True):
        assert search.tool_search(s, f, "part", "class", "definitions", direct=direct, k=None).count() == 60
        assert search.tool_search(s, f, "part", "class", "definitions", direct=direct).count() == 50
    assert search.tool_search(s, f, "part", None, "calls", direct=True, k=None).count() == 60
