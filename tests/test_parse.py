"""Parser facts on small sources."""

import re

from lodestrata.parse import tables
from lodestrata.parse.languages import parse
from lodestrata.parse.source import blanked


def facts(path, text, kind):
    return [r for r in parse(path, text) if r["kind"] == kind]


def names(path, text, kind):
    return [r["name"] for r in facts(path, text, kind)]


def test_blanking_keeps_positions():
    t = "a('x // y'); // it's\n/* b\n c */ d(\"\"\"e\nf\"\"\");"
    b = blanked(t)
    assert len(b) == len(t) and b.count("\n") == t.count("\n") and "it" not in b and "e\n" not in b and "a('" in b


def test_dart_record_typed_variable():
    t = "\nfinal totals =\n    StreamProvider.family<\n      List<Entry>,\n      ({int year, int month})\n    >((ref, params) {\n  final r = ref.watch(x);\n  return r.get(params.year);\n});\n"
    v = facts("a.dart", t, "variable")
    assert [(x["name"], x["is_final"], x["is_top_level"], x["line"]) for x in v] == [("totals", True, True, 2)]


def test_dart_record_return_type():
    t = "class Repo {\n  Future<Either<Failure, (User user, bool flag)>> signIn() async {\n    return Right((user, false));\n  }\n}\n"
    (m,) = facts("a.dart", t, "function")
    assert (m["name"], m["type"], m["parent"], m["is_async"]) == ("signIn", "Future<Either<Failure, (User user, bool flag)>>", "Repo", True)


def test_dart_unnamed_extension():
    (e,) = facts("a.dart", "extension on Duration {\n  Time toTime() => Time(hour: inHours);\n}\n", "extension")
    assert e["on"] == "Duration"


def test_dart_generic_extends():
    t = "final class Left<L, R> extends Either<L, R> {\n  final L value;\n  const Left(this.value);\n}\nclass N extends Notifier<Locale?> {\n  Locale? build() => null;\n}\n"
    c = facts("a.dart", t, "class")
    assert [x["extends_class"] for x in c] == ["Either<L, R>", "Notifier<Locale?>"] and [(x["line"], x["line_end"]) for x in c] == [(1, 4), (5, 7)]
    assert names("a.dart", t, "constructor") == ["Left"] and names("a.dart", t, "property") == ["value"]


def test_dart_local_functions_are_no_methods():
    t = "class M {\n  factory M.of(Map<String, dynamic> map) {\n    DateTime parseTs(dynamic v) {\n      return DateTime.now();\n    }\n    return M(parseTs(map['ts']));\n  }\n  Future<void> send() async {\n    await _share(bytes: []);\n    throw Err(code: 'e');\n  }\n}\n"
    assert names("a.dart", t, "function") == ["send"] and names("a.dart", t, "constructor") == ["M.of"]
    assert {"_share", "Err"} <= set(names("a.dart", t, "call"))


def test_dart_widgets():
    t = "class W extends StatelessWidget {\n  @override\n  Widget build(BuildContext context) {\n    Navigator.push(context, x);\n    const style = TextStyle(fontSize: 14);\n    return Scaffold(\n      appBar: AppBar(title: const Text('Title')),\n      body: Container(\n        child: const SizedBox.shrink(),\n      ),\n    );\n  }\n}\n"
    w = facts("a.dart", t, "widget")
    assert [(x["name"], x["depth"]) for x in w] == [("Scaffold", 0), ("AppBar", 1), ("Text", 2), ("Container", 1), ("SizedBox", 2)]
    assert w[2]["value"] == "Title" and facts("a.dart", t, "class")[0]["type"] == "widget" and names("a.dart", t, "annotation") == ["override"]


def test_dart_apostrophe_in_comment():
    t = "class A {\n  // We'll start\n  void test() {\n    print('done');\n  }\n}\n\nclass B {\n  void next() {}\n}\n"
    assert names("a.dart", t, "class") == ["A", "B"]


def test_dart_imports_enums_mixins():
    t = "import 'package:a/b.dart' as b show X, Y hide Z;\nexport 'c.dart';\nenum Color { red, green(1), blue; void f() {} }\nmixin M on State { int get x => 1; set x(int v) {} }\ntypedef F = void Function(int);\nabstract class C with M, N implements I<J, K> {}\n"
    i = facts("a.dart", t, "import")
    assert [(x["name"], x["type"]) for x in i] == [("package:a/b.dart", "import"), ("c.dart", "export")] and i[0]["show"] == ["X", "Y"] and i[0]["hide"] == ["Z"] and i[0]["alias"] == "b"
    assert facts("a.dart", t, "enum")[0]["values"] == ["red", "green", "blue"] and facts("a.dart", t, "mixin")[0]["on"] == "State"
    c = facts("a.dart", t, "class")
    assert [x["name"] for x in c] == ["M", "C"] and c[1]["mixins"] == ["M", "N"] and c[1]["implements"] == ["I<J, K>"] and c[1]["is_abstract"]
    assert names("a.dart", t, "property") == ["x", "x"] and names("a.dart", t, "typedef") == ["F"]


def test_kotlin():
    t = 'package a.b\nimport x.y.Z as Q\n\nclass Main(val a: Int) : AppCompatActivity(), Clickable {\n    private val name: String = "n"\n    override fun onCreate(b: Bundle?) {\n        setup(name)\n    }\n}\ninterface Clickable { fun click() }\nfun String.shout(): String = uppercase()\nenum class Mode { ON, OFF }\n@Composable\nfun Screen(x: Int) {\n    Text("hi")\n}\n'
    c = facts("a.kt", t, "class")
    assert [(x["name"], x["extends_class"], x["implements"]) for x in c] == [("Main", "AppCompatActivity", ["Clickable"]), ("Screen", "Composable", [])]
    assert names("a.kt", t, "mixin") == ["Clickable"] and names("a.kt", t, "extension") == ["String.shout"] and facts("a.kt", t, "enum")[0]["values"] == ["ON", "OFF"]
    f = {x["name"]: x for x in facts("a.kt", t, "function")}
    assert f["onCreate"]["parent"] == "Main" and f["shout"]["type"] == "String" and "setup" in names("a.kt", t, "call") and facts("a.kt", t, "import")[0]["alias"] == "Q"


def test_java():
    t = "import a.B;\npublic class Foo extends Base implements X, Y {\n  private final int n = 1;\n  public static String run(int a) {\n    return helper(a);\n  }\n}\n"
    (c,) = facts("Foo.java", t, "class")
    assert (c["extends_class"], c["implements"]) == ("Base", ["X", "Y"])
    (f,) = facts("Foo.java", t, "function")
    assert (f["name"], f["type"], f["is_static"], f["value"]) == ("run", "String", True, "int a") and names("Foo.java", t, "property") == ["n"] and "helper" in names("Foo.java", t, "call")


def test_script():
    t = "import { a } from './a'\nimport b from \"b\";\nconst c = require('c');\n\nexport class Foo extends Bar {\n  private x: number = 1\n  constructor(a: string) {\n    super(a)\n  }\n  async run(y: number): Promise<void> {\n    await helper(y)\n  }\n}\nexport const add = (p: number, q: number) => {\n  return p + q\n}\nfunction hidden() { return 1 }\nexport function Page() {\n  return <Box><Item id=\"k\" /></Box>\n}\n"
    assert sorted(names("a.tsx", t, "import")) == ["./a", "b", "c"]
    f = {x["name"]: x for x in facts("a.tsx", t, "function")}
    assert set(f) == {"constructor", "run", "add", "hidden", "Page"} and f["run"]["is_async"] and f["run"]["parent"] == "Foo" and f["hidden"]["hidden"] and not f["add"]["hidden"]
    assert [(x["name"], x["type"]) for x in facts("a.tsx", t, "class")] == [("Foo", "class"), ("Page", "widget")]
    assert [(x["name"], x["depth"]) for x in facts("a.tsx", t, "widget")] == [("Box", 0), ("Item", 1)] and names("a.tsx", t, "property") == ["x"]


def test_markup_gradle_outlines():
    layout = '<LinearLayout>\n  <!-- <Gone/> -->\n  <TextView android:text="Hi" />\n</LinearLayout>'
    assert [(x["name"], x["depth"], x["value"]) for x in facts("l.xml", layout, "widget")] == [("LinearLayout", 0, None), ("TextView", 1, "Hi")]
    assert names("AndroidManifest.xml", '<manifest><uses-permission android:name="P"/><application><activity android:name=".ui.Main"/></application></manifest>', "class") == ["Main"]
    assert [(x["name"], x["value"]) for x in facts("s.xml", '<resources><string name="app">My App</string></resources>', "variable")] == [("app", "My App")]
    g = "android {\n  compileSdk = 34\n}\ndependencies {\n  implementation 'a:b:1'\n  testImplementation(libs.junit)\n}\n"
    assert names("build.gradle", g, "import") == ["a:b:1", "libs.junit"] and [(x["name"], x["value"]) for x in facts("build.gradle", g, "variable")] == [("compileSdk", "34")]
    assert [(x["name"], x["type"]) for x in facts("r.md", "# A\n```\n# no\n```\n## B\n", "class")] == [("A", "H1"), ("B", "H2")]
    assert names("p.json", '{\n  "k": {\n      "deep": 1\n  }\n}', "class") == ["k"] and names("s.css", ":root {\n--c: red;\n}\n.a b {\n}", "variable") == ["--c"]


def test_tables(spark):
    rows = [("a.dart", "class A extends B {\n  void f() { g(); }\n}\nvoid g() {}\n"), ("b.kt", "class K\n"), ("c.txt", "x"), ("d.dart", None)]
    s = tables.parsed(spark.createDataFrame(rows, "path string, content string")).cache()
    assert {(r["path"], r["kind"], r["name"]) for r in s.collect()} == {("a.dart", "class", "A"), ("a.dart", "function", "f"), ("a.dart", "function", "g"), ("a.dart", "call", "g"), ("b.kt", "class", "K")}
    assert {(r["kind"], r["name"]) for r in tables.symbol_spans(s).collect()} == {("class", "A"), ("method", "f"), ("function", "g"), ("class", "K")}
    assert [r["name"] for r in tables.quick_outline(s.where("path = 'a.dart'")).collect()] == ["A", "g"]
    assert tables.search_docs(s).count() == 4


def test_dart_declarations_use_patterns_compiled_once(monkeypatch):
    """No pattern is put together or looked up again for each declaration."""
    from lodestrata.parse import languages, source

    t = "import 'p1.dart' show A, B;\n@immutable\nclass Part extends State<Base> with M {\n  final C c1 = C();\n  int get size => 1;\n  void run() {\n    helper();\n  }\n}\nvoid helper() {\n  return;\n}\nenum E { a, b }\nmixin M on N {}\n"
    want = parse("a.dart", t)

    def never(*_):
        raise AssertionError("a pattern by its text")

    class Quiet:
        match = search = sub = split = staticmethod(never)

        def __getattr__(self, name):
            return getattr(re, name)

    enum = languages.enum_values
    monkeypatch.setattr(languages, "enum_values", lambda body: ["a", "b"])
    assert enum(" a, b ") == ["a", "b"]
    for module in (languages, source):
        monkeypatch.setattr(module, "re", Quiet())
    assert parse("a.dart", t) == want and {"class", "import", "function", "property", "call", "enum", "mixin", "annotation"} == {r["kind"] for r in want}
