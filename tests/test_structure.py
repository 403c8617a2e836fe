"""Components, bounded reach, flows, lexical states, block ends, nearest smaller values, substring joins and the stored index against plain Python."""

import collections
import random
import re
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import audit, components, graph, l10n, lexical, lines, substrings
from lodestrata.operators import search as S
from lodestrata.operators.stored_index import StoredIndex


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def plain_components(pairs):
    """Least node of each strongly connected component, by two depth-first passes."""
    out, back, nodes = collections.defaultdict(set), collections.defaultdict(set), set()
    for a, b in pairs:
        out[a].add(b), back[b].add(a), nodes.update((a, b))
    order, seen = [], set()
    for root in nodes:
        todo = [(root, iter(out[root]))] if root not in seen else []
        seen.add(root)
        while todo:
            node, rest = todo[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                order.append(node)
                todo.pop()
            else:
                seen.add(step)
                todo.append((step, iter(out[step])))
    label = {}
    for root in reversed(order):
        if root not in label:
            group, todo = {root}, [root]
            while todo:
                for x in back[todo.pop()]:
                    if x not in label and x not in group:
                        group.add(x)
                        todo.append(x)
            label.update(dict.fromkeys(group, min(group)))
    return label


# ---- components
@pytest.mark.parametrize("seed", range(3))
def test_components_equal_two_passes(spark, seed):
    rng = random.Random(seed)
    n = 120
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([90, 150, 260]))]
    ring = list(range(200, 230))
    rng.shuffle(ring)
    pairs += list(zip(ring, ring[1:] + ring[:1])) + [(ring[3], 5), (300, ring[7]), (400, 400), (500, 501), (501, 500)]
    trail = [5, *range(600, 625), 17]
    pairs += list(zip(trail, trail[1:]))
    got = {r["node"]: r["component"] for r in components.strong_components(edges_of(spark, pairs)).collect()}
    assert got == plain_components(pairs)
    cyclic = {r["node"] for r in graph.nodes_on_cycles(edges_of(spark, pairs), skip_loops=False).collect()}
    size = collections.Counter(got.values())
    assert cyclic == {v for v, c in got.items() if size[c] > 1} | {a for a, b in pairs if a == b}
    assert components.strong_components(edges_of(spark, pairs).limit(0)).collect() == []


def test_small_parts_are_settled_without_rounds(spark, monkeypatch):
    """Many small parts with branches take no rounds over the edges; a part that is too large for one row still does, with the same result."""
    rng = random.Random(9)
    pairs = []
    for part in range(60):
        ids = rng.sample(range(part * 1000, part * 1000 + 1000), 12)
        pairs += list(zip(ids, ids[1:])) + [(ids[k], ids[k + 2]) for k in range(0, 10, 3)] + [(ids[k], ids[k - 3]) for k in range(3, 12, 4)]
    want = plain_components(pairs)
    steps = []
    real = components.written
    monkeypatch.setattr(components, "written", lambda df, name="step": steps.append(name) or real(df, name))
    got = {r["node"]: r["component"] for r in components.strong_components(edges_of(spark, pairs)).collect()}
    assert got == want and "both-ways" not in steps and steps.count("tagged") == 1
    monkeypatch.setattr(components, "SMALL", 15)
    pairs += [(a, b) for a in range(100_000, 100_006) for b in range(100_000, 100_006) if a != b]
    named = spark.createDataFrame([(f"n{a:06}", f"n{b:06}") for a, b in pairs], "src string, dst string")
    got = {int(r["node"][1:]): int(r["component"][1:]) for r in components.strong_components(named).collect()}
    assert got == plain_components(pairs) and steps.count("tagged") > 2


def test_long_rings_and_chains_take_few_steps(spark, monkeypatch):
    """10,000 nodes in any order: the number of written steps and of jobs stays low."""
    rng = random.Random(4)
    order = list(range(10_000))
    rng.shuffle(order)
    chain, ring = list(zip(order, order[1:])), [(a + 20_000, b + 20_000) for a, b in zip(order, order[1:] + order[:1])]
    steps = []
    real = components.written
    monkeypatch.setattr(components, "written", lambda df, name="step": steps.append(name) or real(df, name))
    for pairs, n in ((chain, 10_000), (ring, 1)):
        steps.clear()
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "components")
        got = components.strong_components(edges_of(spark, pairs))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("rest", "rest")
        assert got.select("component").distinct().count() == n
        assert len(steps) <= 16 and jobs < 60, (len(steps), jobs)


def test_bounded_reach_and_risk(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(100)] + [(k, k + 1) for k in range(100, 130)]
    back = collections.defaultdict(set)
    for a, b in pairs:
        back[b].add(a)

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            for x in back[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return seen

    nodes = {x for p in pairs for x in p}
    got = {r["node"]: (r["ids"], r["n"]) for r in components.reached_by(edges_of(spark, pairs), 17).collect()}
    loops_only = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {v: (sorted(reach(v))[:17], min(17, len(reach(v)))) for v in nodes - loops_only}
    asked = spark.createDataFrame([(v,) for v in [*nodes, 999]], "node long")
    risk = {r["node"]: r["risk"] for r in components.risk_of(edges_of(spark, pairs), asked).collect()}
    level = lambda n: "critical" if n > 15 else "high" if n > 5 else "medium" if n else "low"
    assert risk == {v: level(len(reach(v)) - 1) for v in [*nodes, 999]}
    counts = {r["node"]: r["impacted"] for r in graph.impacted_counts(edges_of(spark, pairs), asked.where("node < 10 or node = 999")).collect()}
    assert counts == {v: len(reach(v)) - 1 for v in [*(x for x in nodes if x < 10), 999]}


@pytest.mark.parametrize("k", [2, 5, 17])
def test_counted_reach_needs_few_steps(spark, monkeypatch, k):
    """As many as reach a node, up to k, by log2(k) written steps: not one for each hop."""
    rng = random.Random(k)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(90)] + [(x, x + 1) for x in range(100, 140)] + [(x, 300) for x in range(200, 240)] + [(300, 301), (300, 300)]
    back = collections.defaultdict(set)
    for a, b in pairs:
        back[b].add(a)
    want = {}
    for v in {b for a, b in pairs if a != b}:
        seen, todo = {v}, [v]
        while todo:
            for x in back[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        want[v] = min(k, len(seen))
    steps = []
    real = components.written
    monkeypatch.setattr(components, "written", lambda df, name="step": steps.append(name) or real(df, name))
    got = {r["node"]: r["n"] for r in components.counted_reach(edges_of(spark, pairs), k).collect()}
    assert got == want and len(steps) <= 1 + k.bit_length()
    steps.clear()
    asked = spark.createDataFrame([(v,) for v in want], "node long")
    assert components.risk_of(edges_of(spark, pairs), asked).count() == len(want) and len(steps) <= 5


def test_all_flows(spark):
    pairs = [("main", "a"), ("main", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "save"), ("b", "save"), ("save", "save"), ("tap", "b"), ("save", "b")]
    calls = spark.createDataFrame(pairs, "src string, dst string")
    entries = spark.createDataFrame([("main", "main"), ("tap", "onTap"), ("save", "save")], "node string, entry string")
    targets = spark.createDataFrame([("save",), ("c",)], "node string")
    out = collections.defaultdict(set)
    for a, b in pairs:
        out[a].add(b)

    def ways(path, target):
        if path[-1] == target:
            yield path
            return
        for x in out[path[-1]]:
            if x not in path and len(path) < 5:
                yield from ways([*path, x], target)

    want = sorted((e, t, len(w) - 1, " -> ".join(w)) for n, e in (("main", "main"), ("tap", "onTap"), ("save", "save")) for t in ("save", "c") for w in ways([n], t))
    got = sorted(map(tuple, graph.all_flows(calls, entries, targets, 5, 50, None).select("entry", "target", "hops", "flow").collect()))
    assert got == want and len({e for e, *_ in want}) < len(want)
    few = [tuple(r) for r in graph.all_flows(calls, entries, targets, 5, 50, 3).select("hops", "entry", "flow").collect()]
    assert few == sorted((h, e, f) for e, _, h, f in want)[:3]
    symbols = spark.createDataFrame([("save", "lib/s.dart"), ("c", "lib/c.dart")], "node string, path string")
    by_file = graph.flows_by_file(calls, entries, symbols, spark.createDataFrame([("lib/c.dart",)], "path string"), 5)
    assert sorted(r["flow"] for r in by_file.collect()) == sorted(f for _, t, _, f in want if t == "c")


# ---- lexical states
def plain_places(text):
    """For each character of a text: c code, b comment, s string, by a character-wise walk."""
    out, state, i = [], None, 0
    while i < len(text):
        rest = text[i:]
        if state is None:
            raw = rest[0] == "r" and not (i and re.match(r"\w", text[i - 1]))
            body = rest[1:] if raw else rest
            quote = next((q for q in ("'''", '"""', "'", '"') if body.startswith(q)), None)
            if quote:
                state = ("raw " if raw else "") + quote
                out += "s" * (len(quote) + raw)
                i += len(quote) + raw
                continue
            for mark in ("//", "/*", "`"):
                if rest.startswith(mark):
                    state = mark
                    out += ("s" if mark == "`" else "b") * len(mark)
                    i += len(mark)
                    break
            else:
                out.append("c")
                i += 1
            if state == "/*" and rest.startswith("/*/"):
                out.append("b")
                i += 1
            continue
        here = "b" if state in ("//", "/*") else "s"
        quote = state.removeprefix("raw ")
        if rest[0] == "\n":
            out.append(here)
            i += 1
            if state in ("//", "'", '"', "raw '", 'raw "'):
                state = None
        elif state == "/*" and rest.startswith("*/"):
            out += "bb"
            i, state = i + 2, None
        elif here == "s" and not state.startswith("raw") and rest[0] == "\\" and len(rest) > 1 and rest[1] != "\n":
            out += "ss"
            i += 2
        elif here == "s" and rest.startswith(quote):
            out += "s" * len(quote)
            i, state = i + len(quote), None
        else:
            out.append(here)
            i += 1
    return out


_PARTS = ["/*", "*/", "//", "'''", '"""', "`", " 'a' ", ' "b" ', " r'c' ", " \\' ", "x", "mark", " mark ", "{", "}", "};", ";", " ", "for", "\n", "\n", "\n", "\n"]


def built_files(seed, count, size):
    rng = random.Random(seed)
    return [(f"f{k}.ts", "".join(rng.choice(_PARTS) + rng.choice(["", " "]) for _ in range(rng.choice([5, size])))) for k in range(count)]


@pytest.mark.parametrize("block", [256, 4])
def test_places_of_matches(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "SCAN", block)
    files = built_files(1, 40, 400)
    rows = lines.lines(spark.createDataFrame(files, "path string, content string"), "ts")
    name = {"c": "code", "b": "comment", "s": "string"}
    want = []
    for path, text in files:
        places = plain_places(text)
        for m in re.finditer("mark", text):
            line = text.count("\n", 0, m.start()) + 1
            want.append((path, line, m.start() - (text.rfind("\n", 0, m.start()) + 1) + 1, name[places[m.start()]]))
    got = lexical.matches(rows, "mark").select("path", "line", "column", "place")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({p for *_, p in want}) == 3
    for c, s in ((True, False), (False, True), (False, False)):
        some = lexical.matches(rows, "mark", c, s).select("path", "line", "column", "place")
        assert sorted(map(tuple, some.collect())) == sorted(x for x in want if (c or x[3] != "comment") and (s or x[3] != "string"))


def test_a_line_is_cut_into_tokens_once(spark):
    """For all states at once, with the states that a walk from each of them gives."""
    texts = ["a 'b' /* c", "*/ d `e", "r'f", 'g " h', "' i", "/ j // k", "` l", "r' m", ""] + ["'" * 3 + " n", '"' * 3 + " o", "r" + "'" * 3]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    each = [lexical._ended(lexical.state_after(F.col("text"), F.lit(s))).alias(f"s{s}") for s in range(lexical.OVER)]
    for got, *want in rows.select(lexical.line_map(F.col("text")), *each).collect():
        assert got == want
    assert str(lexical.line_map(F.col("text"))).count("regexp_extract_all") == 1


def test_block_ends(spark):
    files = built_files(7, 30, 300)
    rows = lines.lines(spark.createDataFrame(files, "path string, content string"), "ts")
    want = {}
    for path, text in files:
        code = "".join(ch if p == "c" or ch == "\n" else "" for ch, p in zip(text, plain_places(text))).split("\n")
        for start in range(len(code)):
            depth, opened, end = 0, False, None
            for i in range(start, len(code)):
                if not opened and code[i].rstrip(" ").endswith(";"):
                    end = i + 1
                    break
                for ch in code[i]:
                    if ch == "{":
                        depth, opened = depth + 1, True
                    elif ch == "}":
                        depth -= 1
                        if opened and depth == 0 and end is None:
                            end = i + 1
                if end:
                    break
            want[path, start + 1] = end
    got = {(r["path"], r["line"]): r["line_end"] for r in lexical.block_ends(rows.select("path", "line"), rows).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 100
    near = {(r["path"], r["line"]): r["line_end"] for r in lexical.block_ends(rows.select("path", "line"), rows, most=1).collect()}
    assert near == {k: v if v is not None and v <= k[1] + 3 else None for k, v in want.items()}


def test_brace_ends_shuffles_lines_once(spark):
    """The files are made, their lines lexed and their blocks ended behind one shuffle, whatever is asked."""
    from lodestrata.plans import structure_queries

    plan = structure_queries.brace_ends(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_block_ends_of_all_lines_and_of_some(spark, monkeypatch):
    """Without symbols all lines are asked for; lines that no file has are not answered, and those given up early have no end."""
    files = built_files(7, 10, 200) + [("deep.ts", "\n".join(["{"] * 300 + ["x"] * 40 + ["}"] * 150)), ("plain.ts", "\n".join(["x"] * 500))]
    rows = lines.lines(spark.createDataFrame(files, "path string, content string"), "ts")
    answers = lambda symbols, *most: {(r["path"], r["line"]): r["line_end"] for r in lexical.block_ends(symbols, rows, *most).collect()}
    whole = answers(None)
    assert len(whole) == rows.count() and whole["deep.ts", 300] == 341 and whole["deep.ts", 1] is None and whole["plain.ts", 1] is None
    some = [(p, n) for p, n in whole if n % 7 == 3]
    asked = spark.createDataFrame([*some, some[0], ("deep.ts", 9999), ("none.ts", 1), (None, 1), ("deep.ts", None)], "path string, line int")
    assert answers(asked) == {k: whole[k] for k in some}
    for give_up in (4096, 0):
        monkeypatch.setattr(lexical, "_GIVE_UP", give_up)
        found = list(lexical._ends(iter([_line_batch(files)]), 50))
        near = {(r["path"], r["line"]): r["line_end"] for b in found for r in b.to_pylist()}
        assert near == {k: v if v is not None and v <= k[1] + 52 else None for k, v in whole.items()}


def _line_batch(files):
    own = [(p, k, lexical._BOTH, t, k) for p, text in files for k, t in enumerate(text.split("\n"), 1)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*own)], ["path", "line", "kind", "text", "place"])


def test_plain_lexer_is_the_column_one(spark):
    rng = random.Random(9)
    texts = ["", "r'\\'", "x/", "// {", "/", "a / b;", "\u0001'x'", ";\u0001", "ür'\\'"] + ["".join(rng.choice(["/", "*", "'", '"', "`", "\\", "r", "x", " ", "{", "}", ";", "//", "/*", "*/", "'''"]) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    code = [lexical.code_of(F.col("text"), F.lit(s)).alias(f"c{s}") for s in range(lexical.OVER)]
    after = [lexical._ended(lexical.state_after(F.col("text"), F.lit(s))).alias(f"s{s}") for s in range(lexical.OVER)]
    for r in rows.select("text", *code, *after).collect():
        assert [lexical._lexed(r["text"], s) for s in range(lexical.OVER)] == [(r[f"c{s}"], r[f"s{s}"]) for s in range(lexical.OVER)]


@pytest.mark.parametrize("fan", [64, 3])
def test_nearest_smaller(spark, monkeypatch, fan):
    monkeypatch.setattr(lexical, "FAN", fan)
    rng = random.Random(6)
    rows = [(f"p{k}", i, rng.randrange(1, 30)) for k in range(3) for i in range(1, rng.choice([2, 90, 700]))]
    rows += [("down", i, 500 - i) for i in range(1, 300)] + [("up", i, i) for i in range(1, 300)]
    want, above = {}, collections.defaultdict(list)
    for path, line, value in rows:
        stack = above[path]
        while stack and stack[-1][1] >= value:
            stack.pop()
        want[path, line] = stack[-1][0] if stack else None
        stack.append((line, value))
    got = lexical.nearest_smaller(spark.createDataFrame(rows, "path string, line int, value int"))
    assert {(r["path"], r["line"]): r["before"] for r in got.collect()} == want
    tree = lexical.indent_tree(lines.lines(spark.createDataFrame([("a", "Row(\n  Text()\n\n  Col(\n    Icon()\n  Box()\nEnd()")], "path string, content string")))
    assert {r["line"]: r["parent_line"] for r in tree.collect()} == {1: None, 2: 1, 4: 1, 5: 4, 6: 1, 7: None}


# ---- substrings
@pytest.mark.parametrize("block", [100_000, 3])
def test_substring_joins(spark, block):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé.") for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None]
    keys = list({"".join(rng.choice("abé.") for _ in range(rng.randint(0, 4))) for _ in range(40)}) + [None, "a"]
    t, k = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in keys], "key string")
    known = {x for x in keys if x is not None}
    assert sorted(r["key"] for r in substrings.keys_within(t, k, block).collect()) == sorted(x for x in known if any(x in y for y in texts if y is not None))
    assert sorted(map(tuple, substrings.pairs_within(t, k, block).collect())) == sorted((y, x) for y in {y for y in texts if y is not None} for x in known if x in y)
    assert substrings.keys_within(t.limit(0), k).collect() == [] and substrings.keys_within(t, k.limit(0)).collect() == []


def test_unused_keys_by_dialect(spark):
    keys = spark.createDataFrame([("p", k) for k in ("title", "sub.title", "tit", "gone", "made")], "path string, key string")
    code = spark.createDataFrame([("lib/a.dart", "t(title); x('sub.title');"), ("lib/generated/b.dart", "made")], "path string, content string")
    assert sorted(r["key"] for r in l10n.unused_keys(keys, code, "ts").collect()) == ["gone", "made", "sub.title", "tit"]
    assert sorted(r["key"] for r in l10n.unused_keys(keys, code, "rs").collect()) == ["gone", "made"]


# ---- names and values by parts
def test_locales_by_parts(spark):
    names = {"app_en": "en", "intl_en_US": "en_US", "messages-pt-BR": "pt_BR", "ar": "ar", "en_US": "en_US", "strings": "strings", "app_eng": "app_eng", "app_EN": "app_EN", "x_ab_cd": "cd", "_de": "de"}
    df = spark.createDataFrame([(f"l10n/{n}.arb", "{}") for n in names], "path string, content string")
    got = {r["path"]: r["l"] for r in df.select("path", l10n.locale_of(F.col("content"), F.col("path")).alias("l")).collect()}
    assert got == {f"l10n/{n}.arb": v for n, v in names.items()}
    files = ["a/app_en.arb", "a/intl_en_US.arb", "a/messages-pt-BR.arb", "ar.arb", "a/en_US.arb", "a/x_fil.arb", "a/x_y-de.arb", "a/bad name_fr.arb", "a/app_it.json", "_nl.arb"]
    df = spark.createDataFrame([(f,) for f in files], "path string")
    assert [r["locale"] for r in l10n.locale_names(df).collect()] == ["de", "en", "en_US", "fil", "nl"]


def test_values_by_parts(spark):
    code = {
        "Color(0xFF112233)": ["Color(0xFF112233)"], "x = Color( 0xFF112233)": [], "Color(0xFFF)": [], "Color.parseColor( '#AABBCC' ), Colors.red.shade": ["Color.parseColor( '#AABBCC' )", "Colors.red"],
        "Color.parseColor('AABBCC')": [], "MyColors.blue_2;": ["Colors.blue_2"], "Colors.": [], "Text('Hi', a)": ["Hi"], 'Text( text = "Hi there" )': ["Hi there"], "MyText('no no')": [], "my Text('yes')": ["yes"],
        "Text('cost $x')": [], "Text('a', b); Text('bc')": [], "Text(label = 'no')": [], "Text('open' + x)": [], "const Text('Save' , x)": ["Save"],
    }
    xml = {'<a android:text = "Hi you"/>': ["Hi you"], '<a android:text="@string/x" android:hint="Your name"/>': ["Your name"], '<a android:textColor="#FFAABBCC"/>': ["#FFAABBCC"], '<a android:tint="#FFG"/>': [], '<a text="Hi you"/>': []}
    web = {"a = { color: '#aabbcc' }": ["#aabbcc"], 'fill : "#aabbccdd"': ["#aabbccdd"], "color: 'red'": [], "x: '#aabbcc'": []}
    for ending, cases in (("dart", code), ("xml", xml), ("tsx", web)):
        df = spark.createDataFrame([(f"f{k}.{ending}", 1, t) for k, t in enumerate(cases)], "path string, line int, text string")
        got = collections.defaultdict(list)
        for r in audit.hardcoded_values(df).collect():
            got[r["path"]].append(r["value"])
        assert {f"f{k}.{ending}": sorted(v) for k, v in enumerate(cases.values()) if v} == {p: sorted(v) for p, v in got.items()}
    near = spark.createDataFrame([("a.dart", 1, "Text('Hello').tr"), ("b.dart", 1, "Text('Hello'); " + "x" * 50 + ".tr")], "path string, line int, text string")
    assert [r["path"] for r in audit.hardcoded_values(near, "ts").collect()] == ["b.dart"]


# ---- the stored index
def read_files(df):
    """Files and files of postings that a frame's scans read, by their metrics."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if "AdaptiveSparkPlan" in node.nodeName():
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            out.append((node.simpleString(200), node.metrics().apply("numFiles").value()))
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    return out


@pytest.mark.parametrize("dialect", ["ts", "rs"])
def test_stored_index_follows_updates(spark, tmp_path, dialect):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("lo", "sa", "qui", "re", "tan") for b in ("gin", "ver", "ck", "stor", "de")]
    docs = lambda ids: [(i, f"{rng.choice(words)}{rng.choice(words).title()}", " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in ids]
    kind = "id long, name string, comments string"
    frame = lambda rows: spark.createDataFrame(rows, kind)
    index, live = StoredIndex(spark, str(tmp_path / "index"), dialect, buckets=16), {}
    assert index.search("logins").collect() == []
    compare = lambda q: ([tuple(r) for r in index.search(q, 20).collect()], [tuple(r) for r in S.search(frame(list(live.values())), q, dialect, 20).collect()])
    close = lambda pair: [r[:2] for r in pair[0]] == [r[:2] for r in pair[1]] and all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(*pair))
    for ids, gone in ((range(60), ()), (range(40, 90), ()), (range(5, 20), (1, 2, 3, 88)), ((2, 100), (7,))):
        rows = docs(ids)
        index.upsert(frame(rows))
        live.update({r[0]: r for r in rows})
        if gone:
            index.remove(spark.createDataFrame([(g,) for g in gone], "id long"))
            live = {k: v for k, v in live.items() if k not in gone}
        assert index.version()["n"] == len(live)
        assert all(close(compare(q)) for q in ("login", "save quiver", "lock tanstor redeck"))
    segments = len(index.version()["segments"])
    scans = read_files(index.postings(["login"]))
    postings = [n for text, n in scans if "tf" in text]
    assert len(postings) == 4 and all(n <= 1 for n in postings) and not any("documents" in text for text, _ in scans)
    index.compacted()
    assert segments == 6 and len(index.version()["segments"]) == 1 and index.version()["n"] == len(live)
    assert all(close(compare(q)) for q in ("login", "save quiver", "lock tanstor redeck"))


def test_stored_index_takes_texts_apart_once(spark, tmp_path):
    """An upsert evaluates each text once, and documents without terms still count."""
    seen = spark.sparkContext.accumulator(0)

    def passed(text):
        seen.add(1)
        return text

    rows = [(1, "goHome", "see the tree the"), (2, "x", None), (3, None, ""), (4, "loginForm", "tree")]
    docs = spark.createDataFrame(rows, "id long, name string, comments string")
    index = StoredIndex(spark, str(tmp_path / "index"), buckets=16)
    index.upsert(docs.withColumn("comments", F.udf(passed, "string")("comments")))
    assert seen.value == 4
    length = {r["id"]: (r["name"], round(r["dl"], 6)) for r in index._table(1, "documents").collect()}
    assert length == {1: ("goHome", 9.2), 2: ("x", 0.0), 3: (None, 0.0), 4: ("loginForm", 8.3)}
    got = {(r["term"], r["id"]): (round(r["tf"], 6), round(r["dl"], 6), r["name"]) for r in index.postings(["the", "tree", "login"]).collect()}
    assert got == {("the", 1): (0.6, 9.2, "goHome"), ("tree", 1): (0.3, 9.2, "goHome"), ("tree", 4): (0.3, 8.3, "loginForm"), ("login", 4): (4.0, 8.3, "loginForm")}
    index.upsert(docs.where("id = 2"))
    assert index.version()["n"] == 4 and abs(index.version()["total"] - 17.5) < 1e-6
    assert [tuple(r) for r in index.search("tree", 5).collect()] == [tuple(r) for r in S.search(docs, "tree", "ts", 5).collect()]


def _shuffled(spark):
    """Bytes that all stages so far wrote for shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_stored_index_is_compacted_without_a_shuffle_of_postings(spark, tmp_path, monkeypatch):
    """Whatever the size of a bucket, its postings are merged where they are, each bucket by a task of its own."""
    docs = spark.createDataFrame([(i, f"n{i}", " ".join(f"w{(i * 7 + k) % 501}" for k in range(60))) for i in range(2000)], "id long, name string, comments string")
    index = StoredIndex(spark, str(tmp_path / "index"), buckets=4)
    index.upsert(docs)
    index.upsert(docs.where("id % 3 = 0"))
    spark.conf.set("spark.sql.maxSinglePartitionBytes", "1k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, wrote = _shuffled(spark), []
        held = index._write_postings
        monkeypatch.setattr(index, "_write_postings", lambda s, rows: (wrote.append(_shuffled(spark)), held(s, rows), wrote.append(_shuffled(spark)))[1])
        index.compacted()
        assert wrote[1] == wrote[0] >= before and spark.conf.get("spark.sql.maxSinglePartitionBytes") == "1k"
    finally:
        for k in ("spark.sql.maxSinglePartitionBytes", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
    files = [f for f in (tmp_path / "index/segments/3/postings").glob("bucket=*/*.parquet")]
    assert len(files) == len({f.parent for f in files}) == 4
    assert [tuple(r) for r in index.search("w17 w30", 20).collect()] == [tuple(r) for r in S.search(docs, "w17 w30", "ts", 20).collect()]


def test_posting_blocks_hold_each_term_once(spark, monkeypatch):
    monkeypatch.setattr(S, "_BLOCK_TERMS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a", None, "c"]), pa.array([5.0, 0.0, 2.0]), pa.array([["go"], [], []]), pa.array([["x1", "go", "x1"], [], ["y1"]]), pa.array([[0], [], []], pa.list_(pa.int32())), pa.array([[1, 0, 1], [], [1]], pa.list_(pa.int32()))], list("abcdefg"))
    for b in (batch, batch.slice(0, 3)):
        got = [r for out in S._blocks(iter([b]), [4.0, 0.5]) for r in out.to_pylist()]
        assert got == [{"id": 1, "name": "a", "dl": 5.0, "bucket": 0, "terms": "go", "tfs": [4.5]}, {"id": 1, "name": "a", "dl": 5.0, "bucket": 1, "terms": "x1", "tfs": [1.0]}, {"id": 3, "name": "c", "dl": 2.0, "bucket": 1, "terms": "y1", "tfs": [0.5]}]


# ---- owners, tool search, streams
def test_calls_reach_their_owners(spark):
    classes = spark.createDataFrame([("Base", None, None, None), ("Mid", "Base", ["Mix"], None), ("Leaf", "Mid<int>", None, ["Face"]), ("Loop", "Loop2", None, None), ("Loop2", "Loop", None, None)], "name string, extends_class string, mixins array<string>, implements array<string>")
    functions = spark.createDataFrame([("run", "Base"), ("run", "Mid"), ("stop", "Base"), ("face", "Face"), ("top", None), ("spin", "Loop")], "name string, parent_class string")
    cases = [
        ("run", None, "Leaf", "go", "method:Mid.run"), ("stop", "this", "Leaf", "go", "method:Base.stop"), ("run", "super", "Leaf", "go", "method:Mid.run"), ("stop", "leaf", None, "main", "method:Base.stop"), ("none", "leaf", None, "main", "method:Leaf.none"),
        ("none", "Leaf", None, "main", "class:Leaf"), ("stop", "Mid", None, "main", "method:Base.stop"), ("mixed", "Mix", None, "main", "mixin:Mix"), ("Leaf", None, None, "main", "class:Leaf"), ("Color", None, None, "main", "enum:Color"),
        ("top", None, "Leaf", "go", "func:top"), ("gone", "x", None, None, "func:gone"), ("spin", None, "Loop2", "go", "method:Loop.spin"), ("face", None, "Leaf", None, "method:Face.face"), ("main", None, None, "main", None),
    ]
    calls = spark.createDataFrame([("a.dart", n, r, c, f) for n, r, c, f, _ in cases], "path string, name string, receiver string, caller_class string, caller_function string")
    others = spark.createDataFrame([("Mix", "mixin"), ("Color", "enum")], "name string, kind string")
    src = lambda c, f: f"method:{c}.{f}" if c and f else f"func:{f}" if f else f"class:{c}" if c else "file:a.dart"
    got = sorted(map(tuple, graph.call_edges(calls, functions, classes, others).select("src", "dst").collect()))
    assert got == sorted({(src(c, f), d) for _, _, c, f, d in cases if d})
    uses = spark.createDataFrame([("class", "A", "a.dart", "b.dart"), ("class", "A", "a.dart", "a.dart"), ("variable", "v", "a.dart", "c.dart"), ("enum", "E", "a.dart", "c.dart")], "kind string, name string, def_path string, used_in string")
    assert sorted(map(tuple, graph.usage_edges(uses).collect())) == [("file:b.dart", "class:A", "uses_class"), ("file:c.dart", "variable:v", "uses_variable")]


def test_tool_search_ranks_before_the_limit(spark):
    from lodestrata.parse import tables

    files = spark.createDataFrame([("lib/login.dart", "class LoginScreen {\n  void login() {\n  }\n}\nvoid helper() {\n  login();\n}\n"), ("lib/other.dart", "/// login login login\nclass PluginLog {\n}\n"), ("lib/b.dart", "final loginCount = 3;\n")], "path string, content string")
    symbols = tables.parsed(files)
    docs = tables.search_docs(symbols)
    plain = S.tool_search(symbols, files, "login", k=50)
    ranked = [tuple(r) for r in S.tool_search(symbols, files, "login", k=50, docs=docs).collect()]
    assert sorted(map(str, ranked)) == sorted(str(tuple(r)) for r in plain.collect())
    best = {r["id"]: r["score"] for r in S.scored(docs, "login", "ts", overlap=False).collect()}
    top = max(best, key=lambda i: best[i])
    assert ranked[0][2] == top.split(":")[0] and ranked[0][0] == "login"
    direct = [tuple(r) for r in S.tool_search(symbols, files, "helper", "function", "definitions", 1, direct=True).select("name", "type", "line").collect()]
    assert direct == [("helper", "function_definition", 5)]
    found = [tuple(r) for r in lines.direct_definitions(lines.lines(files), "l", kind="function").select("name", "line").collect()]
    assert ("helper", 5) in found and ("login", 2) in found and not any(n == 6 for _, n in found)


def test_debounce_with_removals_batch_equals_stream(spark, tmp_path):
    import json
    from datetime import datetime, timedelta

    from lodestrata.streaming import changes

    rng, base = random.Random(12), datetime(2024, 1, 1)
    spec = [(rng.choice("abc"), rng.choice([0, 100, 299, 300, 301, 450, 900]) + 1000 * rng.randrange(6), rng.choice(["Modified", "Modified", "Removed"])) for _ in range(60)]
    rng.shuffle(spec)
    at = lambda ms: base + timedelta(milliseconds=ms)
    batch = changes.debounced_changes(spark.createDataFrame([(k, op, at(ms)) for k, ms, op in spec], "path string, op string, ts timestamp"), ["path"])
    want = sorted((r["path"], r["at"], r["op"]) for r in batch.collect())
    src = tmp_path / "in"
    src.mkdir()
    for n, part in enumerate((spec[:25], spec[25:45], spec[45:], [("z", 10_000_000, "Modified")])):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"path": k, "op": op, "ts": at(ms).isoformat()}) for k, ms, op in part))
    stream = spark.readStream.schema("path string, op string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(src))
    out = changes.debounced_changes_stream(stream, "path", "1 hour")
    q = out.writeStream.format("memory").queryName("debounce_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert sorted((r["key"], r["at"], r["op"]) for r in spark.table("debounce_out").collect()) == want


def test_search_outside_comments_and_strings(spark):
    rows = lines.lines(spark.createDataFrame([("a.ts", "let token = 1; // token\n/* token\n token */ token();\nx = 'token';")], "path string, content string"))
    assert [(r["line"], r["place"]) for r in lines.search_text(rows, "TOKEN", per_match=True, comments=False).collect()] == [(1, "code"), (3, "code"), (4, "string")]
    assert [r["line"] for r in lines.search_text(rows, "token", comments=False, strings=False).collect()] == [1, 3]


def test_batches_of_translations(spark):
    t = spark.createDataFrame([("l10n/en.arb", "en", "hi", "Hi"), ("l10n/de.arb", "de", "hi", "Hallo"), ("l10n/de_AT.arb", "de_AT", "hi", "Servus")], "path string, locale string, key string, value string")
    updates = spark.createDataFrame([("de", "hi", "Na"), ("en", "bye", "Bye"), ("fr", "hi2", "Salut"), ("en", "bad key", "x"), ("en", "empty", "  ")], "locale string, key string, value string")
    fresh, report = l10n.batch_applied(t, updates)
    assert sorted(tuple(r) for r in fresh.select("locale", "key", "value").collect()) == [("de", "hi", "Na"), ("de_AT", "hi", "Na"), ("en", "bye", "Bye"), ("en", "hi", "Hi")]
    assert {r["key"]: r["applied"] for r in report.collect()} == {"hi": True, "bye": True, "hi2": False, "bad key": False, "empty": False}
    with pytest.raises(ValueError, match="nothing was changed"):
        l10n.batch_applied(t, updates, t.limit(1))


@pytest.mark.parametrize("dialect", ["ts", "rs"])
def test_cycle_list_equals_a_depth_first_search(spark, dialect):
    rng = random.Random(9)
    pairs = sorted({(f"n{rng.randrange(12):02d}", f"n{rng.randrange(12):02d}") for _ in range(26)})
    out, seen, found = collections.defaultdict(list), set(), []
    for a, b in pairs:
        if dialect == "rs" or a != b:
            out[a].append(b)

    def visit(node, path):
        seen.add(node)
        for x in out[node]:
            if x in path:
                found.append([*path[path.index(x) :], x])
            elif x not in seen:
                visit(x, [*path, x])

    for a in sorted(out):
        if a not in seen:
            visit(a, [a])
    if dialect == "ts":
        turned = {}
        for c in found:
            k = c.index(min(c[:-1]))
            turned.setdefault(tuple(c[k:-1] + c[:k]), c)
        found = sorted(turned.values(), key=len)
    got = [(r["cycle"], r["nodes"]) for r in graph.cycle_list(spark.createDataFrame(pairs, "src string, dst string"), dialect).orderBy("cycle").collect()]
    assert got == list(enumerate(found)) and len(found) > 3


def test_package_filters_and_slices(spark):
    from lodestrata.sources import packages

    p = spark.createDataFrame([("a", "1", "hosted", "direct main"), ("b", "1", "git", "direct main"), ("c", "1", "hosted", "transitive")], "name string, version string, source string, dependency_type string")
    names = lambda *how: sorted(r["name"] for r in packages.packages_where(p, *how).collect())
    assert names() == ["a", "b", "c"] and names("direct main") == ["a", "b"] and names(None, "hosted") == ["a", "c"] and names("direct main", "hosted") == ["a"]
    config = spark.createDataFrame([("http", "/cache/http/lib/")], "name string, root string")
    files = spark.createDataFrame([("/cache/http/lib/src/a.dart", "one\ntwo\nthree\nfour\n"), ("/cache/other/lib/src/a.dart", "no")], "path string, content string")
    got = packages.read_package_source(config, files, "package:http/src/a.dart", 2, 2)
    assert [(r["line"], r["text"]) for r in got.collect()] == [(2, "two"), (3, "three")]
