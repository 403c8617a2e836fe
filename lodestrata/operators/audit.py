"""Rule-based audits over lines and parsed tables: hard-coded values, mock-ups, duplicates, leaks, assets, layers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.graph import coupling
from lodestrata.operators.substrings import keys_within
from lodestrata.sources.shared import written

# ---- hard-coded values: what may hold one, by file family -------------------------------------------------
# fixed values: names of calls, attributes and properties
COLOR_CALL, COLOR_PARSER, COLOR_MEMBERS, TEXT_CALL, TEXT_ARGUMENT = "Color", ".parse", "s.", "Text", "text"
XML_PREFIX, XML_TEXTS, XML_COLORS = "android:", ("text", "hint", "contentDescription"), ("background", "textColor", "tint", "backgroundTint")
STYLE_COLORS = ("color", "backgroundColor", "borderColor", "fill", "stroke")
_QUOTE, _WORD = """["']""", "abcdefghijklmnopqrstuvwxyz0123456789_"


def _one_of(words) -> str:
    return f"(?:{'|'.join(map(re.escape, words))})"


def _only(c: Column, letters: str) -> Column:
    """Nothing but these characters, in any case."""
    return F.translate(F.lower(c), letters, "") == ""


def _hex(c: Column) -> Column:
    return F.char_length(c).between(6, 8) & _only(c, "0123456789abcdef")


def _without_end(c: Column, end: str) -> Column:
    """A text less its ending and the white space around that; null where it ends otherwise."""
    bare = F.rtrim(c)
    return F.when(F.endswith(bare, F.lit(end)), F.rtrim(F.substring(bare, F.lit(1), F.char_length(bare) - len(end))))


def _quoted_values(text: Column) -> Column:
    """The quoted pieces of a line, each with what stands before and behind it."""
    pieces = F.split(text, _QUOTE, -1)
    inner = F.when(F.size(pieces) > 2, F.sequence(F.lit(1), F.size(pieces) - 2)).otherwise(F.array().cast("array<int>"))
    rest = lambda k: F.char_length(F.array_join(F.slice(pieces, 1, k + 1), " ")) + 2
    return F.transform(inner, lambda k: F.struct(F.get(pieces, k - 1).alias("front"), F.get(pieces, k).alias("value"), F.substring(text, rest(k), F.lit(1 << 30)).alias("behind")))


def _set_to(text: Column, names, sign: str, fits) -> Column:
    """Quoted values of a line that one of the names is set to and that fit."""
    named = lambda front: F.coalesce(reduce(lambda x, y: x | y, [F.endswith(_without_end(front, sign), F.lit(n)) for n in names]), F.lit(False))
    return F.transform(F.filter(_quoted_values(text), lambda q: named(q["front"]) & fits(q["value"])), lambda q: q["value"])


def _hash_color(c: Column) -> Column:
    return F.startswith(c, F.lit("#")) & _hex(F.substring(c, 2, 1 << 30))


def _resource_free(c: Column) -> Column:
    """A text that is no reference to a resource, an attribute or a binding."""
    return (c != "") & ~_holds(c, ("@", "?", "{"))


def _code_colors(code: Column) -> Column:
    """Colours as code writes them: what stands behind each mention of the call's name decides."""
    pieces = F.split(code, COLOR_CALL, -1)
    after = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))

    def written_color(k: Column) -> Column:
        piece, follows = F.get(pieces, k), F.coalesce(F.get(pieces, k + 1), F.lit(""))
        number, argument = (F.substring_index(c, ")", 1) for c in (piece, follows))
        told = F.trim(F.substring(argument, 2, 1 << 30))
        string = F.startswith(argument, F.lit("(")) & F.substring(told, 1, 1).isin("'", '"') & F.substring(told, -1, 1).isin("'", '"') & _hash_color(F.substring(told, F.lit(2), F.char_length(told) - 2))
        member = F.substring(piece, 3, 1 << 30)
        name = F.substring_index(F.translate(F.regexp_replace(member, r"\W", " "), "\t", " "), " ", 1)
        return (
            F.when(F.startswith(piece, F.lit("(0x")) & F.contains(piece, F.lit(")")) & _hex(F.substring(number, 4, 1 << 30)), F.concat(F.lit(COLOR_CALL), number, F.lit(")")))
            .when((piece == COLOR_PARSER) & F.contains(follows, F.lit(")")) & string, F.concat(F.lit(COLOR_CALL + COLOR_PARSER + COLOR_CALL), argument, F.lit(")")))
            .when(F.startswith(piece, F.lit(COLOR_MEMBERS)) & (name != ""), F.concat(F.lit(COLOR_CALL + COLOR_MEMBERS), name))
        )

    return F.array_compact(F.transform(after, written_color))


def _code_texts(code: Column) -> Column:
    """Texts (value, around) that are the first argument, or the one named text, of their call, without interpolation or escapes; ``around`` is the value with what follows."""

    call = f"{TEXT_CALL}("

    def opens(front: Column) -> Column:
        bare = F.coalesce(_without_end(_without_end(front, "="), TEXT_ARGUMENT), F.rtrim(front))
        before = F.when(F.char_length(bare) > len(call), F.substring(bare, F.char_length(bare) - len(call), F.lit(1))).otherwise(" ")
        return F.endswith(bare, F.lit(call)) & ~_only(before, _WORD)  # no word goes on into the call's name

    plain = lambda v: (v != "") & ~_holds(v, ("$", "\\"))
    ends = lambda c: F.substring(F.ltrim(c), 1, 1).isin(",", ")")
    found = F.filter(_quoted_values(code), lambda q: opens(q["front"]) & plain(q["value"]) & ends(q["behind"]))
    return F.transform(found, lambda q: F.struct(q["value"].alias("value"), F.concat(q["value"], F.substring(F.ltrim(q["behind"]), F.lit(1), F.lit(1 + NEAR))).alias("around")))


# fixed values: literal marks of unfinished code
MOCKUP_MARKS = (
    "TODO", "FIXME", "Lorem ipsum", "setState(() {})", "onPressed: () {}", "onClick = {}", "setOnClickListener {}",
    "onClick={() => {}}", "throw UnimplementedError", "Placeholder(",
)
# fixed values: resource types that must be released, and the calls that release them
RESOURCES = (
    "AnimationController", "TextEditingController", "ScrollController", "TabController", "PageController", "FocusNode",
    "StreamSubscription", "StreamController", "ValueNotifier",
)
RELEASES = ("dispose", "cancel", "close")


def code_lines(rows: DataFrame) -> DataFrame:
    """Lines outside block comments, whole-line comments and import lines, with ``code`` (text up to //).

    A block comment runs from a line that begins with /* and does not close to the next line with */; the state is a
    running maximum of the last opening and closing line within the file.
    """
    t = F.trim("text")
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    opens, closes = F.startswith(t, F.lit("/*")) & ~F.contains(t, F.lit("*/")), F.contains(t, F.lit("*/"))
    state = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(order)
    inside = F.coalesce(state, F.lit(False))
    tail = F.trim(F.regexp_extract(t, r"\*/(.*)$", 1))
    shown = F.when(inside, F.when(closes, tail).otherwise("")).otherwise(t)
    rows = rows.withColumn("shown", shown)
    comment = F.col("shown").rlike(r"^(//|/\*|\*|import |export |part )")
    return rows.where((F.col("shown") != "") & ~comment).withColumn("code", F.substring_index("shown", "//", 1)).drop("shown")


# fixed values: ts does not report texts with these near by, and no colours of files whose path names them
LOCALISED, COLOR_FILES, NEAR = (".tr", "S.of", "Intl.message"), ("theme", "color"), 40


def hardcoded_values(rows: DataFrame, dialect: str = "rs") -> DataFrame:
    """(path, line, type, value) of hard-coded texts and colours, by file extension.

    ts takes one colour of a line, none in files of themes and colours, and no text that is looked up in a translation.
    """
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    letters = lambda c: (F.char_length(F.trim(c)) > 1) & c.rlike(r"\p{L}")
    marked = lambda values, kind: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), F.trim(v).alias("value")))
    first = lambda found: F.slice(found, 1, 1)
    t = F.trim("text")
    of_xml = lambda names: [f"{XML_PREFIX}{n}" for n in names]
    xml_texts, xml_colors = _set_to(t, of_xml(XML_TEXTS), "=", _resource_free), _set_to(t, of_xml(XML_COLORS), "=", _hash_color)
    xml = rows.where((ext == "xml") & ~F.startswith(t, F.lit("<!--"))).select("path", "line", F.concat(marked(F.filter(first(xml_texts), letters), "hardcoded_text"), marked(first(xml_colors), "hardcoded_color")).alias("found"))
    web = rows.where(ext.isin("ts", "tsx", "js", "jsx") & ~t.rlike(r"^(//|/\*|\*)")).select("path", "line", marked(first(_set_to(t, STYLE_COLORS, ":", _hash_color)), "hardcoded_color").alias("found"))
    code = code_lines(rows.where(~ext.isin("xml", "ts", "tsx", "js", "jsx")))
    colors = F.filter(marked(_code_colors(F.col("code")), "hardcoded_color"), lambda x: x["value"] != "Colors.transparent")
    said = first(_code_texts(F.col("code")))
    texts = F.filter(said, lambda x: letters(x["value"]))
    if dialect == "ts":
        themed = reduce(lambda a, b: a | b, [F.contains(F.lower("path"), F.lit(w)) for w in COLOR_FILES])
        colors, texts = F.when(themed, F.slice(colors, 1, 0)).otherwise(first(colors)), F.filter(texts, lambda x: ~_holds(x["around"], LOCALISED))
    texts = marked(F.transform(texts, lambda x: x["value"]), "hardcoded_text")
    rest = code.select("path", "line", F.concat(colors, texts).alias("found"))
    return reduce(DataFrame.unionByName, [xml, web, rest]).select("path", "line", F.explode("found").alias("f")).select("path", "line", "f.type", "f.value")


# fixed values: short names of kinds of warnings; a kind that ends in _ means all that begin so
WARNING_KINDS = {"text": "hardcoded_text", "color": "hardcoded_color", "mockup": "mockup_"}


def warnings_where(found: DataFrame, kind: str | None = None, text: str | None = None, path: str | None = None) -> DataFrame:
    """Warnings (path, line, type, value) of a kind or its short name, with a text in the value and in the path, in any case."""
    if kind and kind != "all":
        kind = WARNING_KINDS.get(kind, kind)
        found = found.where(F.startswith("type", F.lit(kind)) if kind.endswith("_") else F.col("type") == kind)
    for column, part in (("value", text), ("path", path)):
        if part:
            found = found.where(F.contains(F.lower(column), F.lit(part.lower())))
    return found


def warnings_by_file(found: DataFrame) -> DataFrame:
    """(path, n, by_type) of warnings: counts by type."""
    per = found.groupBy("path", "type").agg(F.count("*").alias("n"))
    return per.groupBy("path").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat("type", F.lit("="), F.col("n").cast("string")))), ",").alias("by_type"))


def rule_hits(rows: DataFrame, marks: tuple = MOCKUP_MARKS) -> DataFrame:
    """(path, line, mark): one row for each mark that a line contains; row-local."""
    found = F.filter(F.array(*map(F.lit, marks)), lambda m: F.contains(F.col("text"), m))
    return rows.select("path", "line", F.explode(found).alias("mark"), F.trim("text").alias("snippet"))


# ---- mock-ups: fixed values, the names by which unfinished code is known -----------------------------------------
COMMENT_MARKS = ("TODO", "FIXME", "MOCK", "DUMMY", "STUB", "TEMP", "HACK", "PLACEHOLDER")
STUB_CALLS = ("Placeholder", "TODO", "throw UnimplementedError", "throw NotImplementedError", "throw UnsupportedOperationException", "throw new NotImplementedError", "throw new UnsupportedOperationException")
NULL_HANDLERS = ("onPressed", "onTap")
# fixed values: handlers that are set with a colon, with = and a block, with = and a function, and by a call; and those that count where they only log
NAMED_HANDLERS = ("onPressed", "onTap", "onLongPress", "onDoubleTap", "onChanged", "onSubmitted", "onSaved", "onSelected", "onTapDown", "onTapUp")
BLOCK_HANDLERS = (
    "onClick", "onValueChange", "onCheckedChange", "onItemClick", "onDismissRequest", "onRefresh", "onSearch", "onBack", "onEdit", "onDelete", "onSave", "onSelect", "onLongClick", "onMenuClick",
    "onCurrencyClick", "onLanguageClick", "onCardClick", "onItemSelect",
)
WEB_HANDLERS = ("onClick", "onChange", "onSubmit", "onSelect", "onPress", "onBlur", "onFocus")
LISTENERS = ("setOnClickListener", "setOnItemClickListener", "setOnCheckedChangeListener", "setOnLongClickListener", "setOnTouchListener")
LOGGING_HANDLERS = ("onPressed:", "onTap:", "onChanged:", "onSubmitted:", "onClick=", "onValueChange=", "onCheckedChange=", "setOnClickListener", "onClick=>", "onChange=>", "onSubmit=>", "onPress=>")
LOGGERS = ("print", "debugPrint", "log", "println", "Log.d", "Log.e", "Log.v", "Log.i", "Log.a", "Log.w", "Toast.makeText", "System.out.print", "console.log", "console.debug", "console.warn", "console.error")
# fixed values: beginnings of invented names, what they may not go on as, and what declares a name
FAKE_NAMES, FAKE_TYPES, REAL_NAMES = ("mock", "dummy", "fake", "sample", "stub", "temp"), ("Mock", "Dummy", "Fake", "Stub", "Sample"), ("mockup", "tempdb")
VARIABLE_WORDS, COLLECTIONS, TYPE_WORDS = ("final", "const", "var", "val", "let"), ("list", "map", "arraylist", "set", "array"), ("object", "class")
FAKE_HOSTS = ("via.placeholder.com", "picsum.photos", "placehold.co", "dummyimage.com", "avatar.iran.liara.run", "placeholder.com")
FAKE_TEXTS = ("lorem ipsum", "john doe", "jane doe", "test@test.com", "user@example.com", "123456789", "1234567890", "+123456789", "+1234567890", "اسم تجريبي", "نص تجريبي", "عنوان تجريبي", "بيانات وهمية")
SAMPLE_NAMES, SAMPLE_SOURCE, SAMPLE_LAYOUTS, SAMPLE_WORDS = ("tools:text", "tools:src", "tools:srccompat", "tools:listitem"), "@tools:sample/", "@layout/", ("dummy", "mock", "sample", "placeholder")
SLOW_CALLS = ("Future.delayed", "Thread.sleep", "delay")
TIMER_WORDS = ("timer", "countdown", "cooldown", "resend", "periodic", "dowhile", "while")
CATEGORIES = ("comment", "callback", "widget", "data", "async", "input")
TEST_FOLDERS, TEST_ENDINGS = ("test", "tests", "androidTest"), ("test", "spec")


def _tight(text: Column) -> Column:
    """A line without the white space around its signs, so that a form is one literal."""
    return F.regexp_replace(text, r"\s*([^\w\s])\s*", "$1")


def _holds(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def _marked(text: Column) -> Column:
    """A comment whose first word is a mark."""
    firsts = F.regexp_extract_all(text, F.lit(r"(?://|<!--)\s*(\w+)"), F.lit(1))
    return F.exists(firsts, lambda w: F.upper(w).isin(*COMMENT_MARKS))


def _without_bodies(text: Column, logs: bool) -> Column:
    """A line in which what does nothing reads {}: parameters, wrappers and constants are struck out, and calls that only log where these count."""
    bare = F.replace(F.regexp_replace(_tight(text), r"=>(?:null|true|false)\b", "{}"), F.lit("(null)"), F.lit("{}"))
    if logs:
        bare = F.regexp_replace(bare, rf"\b{_one_of(LOGGERS)}\([^()]*\)(?:\.show\(\))?;?", "")
    # a function in a block has a sign of its own
    bare = F.regexp_replace(bare, r"=\{(?:\([\w?, ]*\)=>|function\([^()]*\))", "=>{")
    bare = F.regexp_replace(bare, r"\basync\b\s*|@Override\s*|public void \w+\([^()]*\)|new [\w.]+\([^()]*\)", "")
    return F.regexp_replace(bare, r"\([\w?, ]*\)(?:=>)?|[\w?,-]+->", "")


def _idle(text: Column) -> Column:
    """A known handler that does nothing, or that only logs."""
    empty = lambda logs: F.regexp_extract_all(_without_bodies(text, logs), F.lit(r"(\w+(?::|=>|=)?)\(?\{*\{\}"), F.lit(1))
    known = [*(f"{h}:" for h in NAMED_HANDLERS), *(f"{h}=" for h in BLOCK_HANDLERS), *(f"{h}=>" for h in WEB_HANDLERS), *LISTENERS]
    return F.arrays_overlap(empty(False), F.array(*map(F.lit, known))) | F.arrays_overlap(empty(True), F.array(*map(F.lit, LOGGING_HANDLERS)))


def _nulled(text: Column) -> Column:
    """A handler that is set to null."""
    return F.arrays_overlap(F.regexp_extract_all(_tight(text), F.lit(r"(\w+):null\b"), F.lit(1)), F.array(*map(F.lit, NULL_HANDLERS)))


def _invented(text: Column) -> Column:
    """A variable that is given a value under a name that begins as invented data does, or a type that is named so."""
    tight = F.lower(_tight(text))
    names = F.concat(*[F.regexp_extract_all(tight, F.lit(form), F.lit(1)) for form in (rf"\b{_one_of(VARIABLE_WORDS)} (\w+)[:=]", rf"\b{_one_of(COLLECTIONS)}<[\w?, ]+>(\w+)[:=]")])
    types = F.regexp_extract_all(text, F.lit(rf"\b{_one_of(TYPE_WORDS)}\s+(\w+)"), F.lit(1))
    begins = lambda n, words: reduce(lambda a, b: a | b, [F.startswith(n, F.lit(w)) for w in words])
    return F.exists(names, lambda n: begins(n, FAKE_NAMES) & ~begins(n, REAL_NAMES)) | F.exists(types, lambda n: begins(n, FAKE_TYPES) & ~begins(F.lower(n), REAL_NAMES))


def _sampled(text: Column) -> Column:
    """A layout attribute for the designer that shows sample data, or a layout named as such."""
    shown = lambda v: F.startswith(v, F.lit(SAMPLE_SOURCE)) | (F.startswith(v, F.lit(SAMPLE_LAYOUTS)) & _holds(v, SAMPLE_WORDS))
    return F.size(_set_to(F.lower(text), SAMPLE_NAMES, "=", shown)) > 0


def _quoted(text: Column) -> Column:
    strings = F.regexp_extract_all(F.lower(text), F.lit(rf"{_QUOTE}([^\"']*){_QUOTE}"), F.lit(1))
    return F.exists(strings, lambda q: q.isin(*FAKE_TEXTS[1:]) | F.startswith(q, F.lit(FAKE_TEXTS[0])))


#: type, category, severity, what a line must fulfil, and whether test files count
MOCKUP_RULES = (
    ("mockup_todo_comment", "comment", "info", _marked, True),
    ("mockup_empty_callback", "callback", "warning", _idle, True),
    ("mockup_null_callback", "callback", "info", _nulled, True),
    ("mockup_stub_widget", "widget", "warning", lambda t: _holds(_tight(t), [f"{c}(" for c in STUB_CALLS]), True),
    ("mockup_fake_data", "data", "warning", _invented, False),
    ("mockup_fake_data", "data", "info", lambda t: _holds(F.lower(t), FAKE_HOSTS) | _sampled(t) | _quoted(t), False),
)


UI_FOLDERS = ("pages", "screens", "widgets", "presentation", "ui", "compose", "activities", "fragments")
#: Input controls: their names, the sign of an argument, the argument of the state and those of the handler, and what an idle handler is.
TOGGLES = (
    (("Checkbox", "Switch", "Radio", "CupertinoSwitch"), ":", ("value",), ("onChanged",), "null"),
    (("Checkbox", "Switch", "RadioButton", "TriStateCheckbox"), "=", ("checked", "selected"), ("onCheckedChange", "onClick"), "{}"),
)


def unbound_inputs(files: DataFrame) -> DataFrame:
    """(path, line, type, category, severity) of input controls with a constant state and an idle handler, over several lines.

    The arguments are read up to the first closing bracket.  Lines are numbered by a running total of the line ends before each
    control, within files that have one.
    """
    form = rf"\b({_one_of(sorted({n for t in TOGGLES for n in t[0]}))})\s*\(([^)]+)\)"
    rows = files.where(F.col("content").rlike(form))
    breaks = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    whole, names, bodies = (F.regexp_extract_all("content", F.lit(form), F.lit(g)) for g in (0, 1, 2))
    x = rows.select("path", F.posexplode(F.arrays_zip(F.split("content", form).alias("before"), whole.alias("control"), names.alias("name"), bodies.alias("body"))).alias("n", "x")).select("path", "n", "x.*")
    upto = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    line = F.sum(breaks(F.col("before")) + F.coalesce(breaks(F.col("control")), F.lit(0))).over(upto) - breaks(F.col("control")) + 1
    x = x.withColumn("line", line.cast("int")).where("control is not null")
    # one literal for each argument: no white space, no parameters of a handler
    given = F.transform(F.split("body", ","), lambda a: F.regexp_replace(F.regexp_replace(a, r"\s", ""), r"\{[\w?]+->\}", "{}"))
    idle = F.lit(False)
    for owners, sign, states, handlers, nothing in TOGGLES:
        fixed = F.array(*[F.lit(f"{s}{sign}{v}") for s in states for v in ("true", "false")])
        empty = F.array(*[F.lit(f"{h}{sign}{nothing}") for h in handlers])
        idle = idle | (F.col("name").isin(*owners) & F.arrays_overlap(given, fixed) & F.arrays_overlap(given, empty))
    return x.where(idle).select("path", "line", F.lit("mockup_unbound_input").alias("type"), F.lit("input").alias("category"), F.lit("warning").alias("severity"))


def duplicate_warnings(bodies: DataFrame, least: int = 50, least_in_file: int = 80) -> DataFrame:
    """(path, line, name, scope, n, others) of bodies (path, line, name, parent, type, body_hash, body_length) that occur more than once.

    scope ``project``: at least ``least`` long, up to three others by ``name in file``; scope ``file``: at least ``least_in_file``
    long, all others of the file by ``owner.name (line n)``.  Of a group the project keeps its first four members only: they are
    found by a ranked aggregate that each task cuts to four before the shuffle.
    """
    b = bodies.where(F.col("body_hash").isNotNull() & (F.col("body_length") >= least)).select("path", "line", "name", "parent", "type", "body_hash", "body_length")
    me = F.struct("path", "line", "name")
    n = b.groupBy("body_hash").agg(F.count("*").alias("n")).where("n > 1")
    few = b.withColumn("r", F.row_number().over(Window.partitionBy("body_hash").orderBy("path", "line", "name"))).where("r <= 4")
    few = few.groupBy("body_hash").agg(F.array_sort(F.collect_list(me)).alias("few"))
    base = lambda p: F.element_at(F.split(p, "/"), -1)
    rest = F.slice(F.filter("few", lambda o: o != me), 1, 3)
    said = F.array_join(F.transform(rest, lambda o: F.concat(o["name"], F.lit(" in "), base(o["path"]))), ", ")
    project = b.join(n.join(few, "body_hash"), "body_hash").select("path", "line", "name", F.lit("project").alias("scope"), "n", said.alias("others"))
    same = b.where(F.col("body_length") >= least_in_file).groupBy("path", "body_hash").agg(F.array_sort(F.collect_list(F.struct("line", F.concat_ws(".", "parent", "name").alias("label"), "name"))).alias("all")).where("size(all) > 1")
    same = same.select("path", "all", F.explode("all").alias("m"))
    other = F.filter("all", lambda o: o != F.col("m"))
    listed = F.array_join(F.transform(other, lambda o: F.concat(o["label"], F.lit(" (line "), o["line"].cast("string"), F.lit(")"))), ", ")
    return project.unionByName(same.select("path", "m.line", "m.name", F.lit("file").alias("scope"), F.size("all").cast("long").alias("n"), listed.alias("others")))


def diagnostics_where(found: DataFrame, path: str | None = None, severity: str | None = None) -> DataFrame:
    """Diagnostics of a file (the end of its path) and of a severity, in any case."""
    if path:
        found = found.where(F.endswith(F.lower(F.replace("file", F.lit("\\"), F.lit("/"))), F.lit(path.lower())))
    return found.where(F.lower("severity") == severity.lower()) if severity else found


def diagnostics_report(found: DataFrame, exit_code: int | None = 0, target: str | None = None, timed_out: bool = False) -> DataFrame:
    """One row: success, n, errors.  A run that fails without a diagnostic is no success."""
    if target and target != ".":
        place, file = target.rstrip("/"), F.replace("file", F.lit("\\"), F.lit("/"))
        found = found.where((file == place) | F.startswith(file, F.lit(place + "/")))
    row = found.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("errors"))
    failed = F.lit(timed_out or exit_code is None) | ((F.col("n") == 0) & F.lit(exit_code != 0))
    return row.select((~failed & (F.col("errors") == 0)).alias("success"), "n", "errors")


def _in_test(path: Column) -> Column:
    parts = F.split(path, "/")
    name = F.split(F.lower(F.element_at(parts, -1)), "[._-]")
    return F.arrays_overlap(parts, F.array(*map(F.lit, TEST_FOLDERS))) | F.arrays_overlap(F.slice(name, 2, F.greatest(F.size(name) - 2, F.lit(0))), F.array(*map(F.lit, TEST_ENDINGS)))


def mockups(rows: DataFrame, ui_only: bool = False) -> DataFrame:
    """(path, line, type, category, severity): rules per line, and delays without a timer within two lines
    (ui_only: delays in folders of the user interface alone)."""
    test, slow = _in_test(F.col("path")), _holds(_tight(F.col("text")), [f"{c}(" for c in SLOW_CALLS])
    found = [F.when(rule(F.col("text")) & (F.lit(anywhere) | ~test), F.struct(F.lit(t).alias("type"), F.lit(c).alias("category"), F.lit(s).alias("severity"))) for t, c, s, rule, anywhere in MOCKUP_RULES]
    placed = _holds(F.col("path"), [f"/{f}/" for f in UI_FOLDERS]) if ui_only else F.lit(True)
    near = Window.partitionBy("path").orderBy("line").rowsBetween(-2, 2)
    # the window is over files that have a delay at all
    around = rows.join(rows.where(slow).select("path").distinct(), "path", "left_semi").withColumn("near", F.lower(F.concat_ws("\n", F.collect_list("text").over(near))))
    delays = around.where(slow & placed & ~_holds(F.col("near"), TIMER_WORDS) & ~test).select("path", "line", F.lit("mockup_fake_delay").alias("type"), F.lit("async").alias("category"), F.lit("info").alias("severity"))
    hits = rows.select("path", "line", F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("f")).select("path", "line", "f.type", "f.category", "f.severity")
    return hits.unionByName(delays)


def category_breakdown(findings: DataFrame, categories: tuple = CATEGORIES) -> DataFrame:
    """(category, n) with a zero for each category without findings."""
    base = findings.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return base.join(findings.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def body_fingerprint(body: Column, name: Column | None = None) -> Column:
    """md5 of a body without its own name and white space."""
    b = F.replace(body, name, F.lit("")) if name is not None else body
    return F.md5(F.regexp_replace(b, r"\s+", ""))


def duplicate_bodies(bodies: DataFrame, least_length: int = 50) -> DataFrame:
    """(fingerprint, n, length, first, others): bodies that occur more than once; at most three others are named.

    bodies: id, body.  Members are counted by a combined aggregate; the rank stands directly above the rows with its limit, so
    each task keeps four ids of a group before the shuffle.
    """
    b = bodies.select("id", F.regexp_replace("body", r"\s+", "").alias("b")).select("id", F.md5("b").alias("fingerprint"), F.char_length("b").alias("length")).where(F.col("length") >= least_length)
    w = Window.partitionBy("fingerprint").orderBy("id")
    groups = b.groupBy("fingerprint").agg(F.count("*").alias("n"), F.max("length").alias("length"), F.min("id").alias("first")).where("n > 1")
    few = b.select("fingerprint", "id").withColumn("r", F.row_number().over(w)).where("r <= 4")
    named = few.where("r > 1").groupBy("fingerprint").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("others"))
    return groups.join(named, "fingerprint")


def tree_signatures(nodes: DataFrame, ordered: bool = True) -> DataFrame:
    """(path, node_id, signature, size, depth) of every subtree, from the deepest level up.

    nodes: path, node_id, parent_id, ord, depth, name.
    """
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select("path", "node_id", F.lit("").alias("signature"), F.lit(1).alias("size"), "depth").limit(0)
    done, below = None, None
    for level in range(deepest, -1, -1):
        here = nodes.where(F.col("depth") == level)
        if below is not None:
            sort = F.array_sort(F.collect_list(F.struct(F.col("ord") if ordered else F.col("signature").alias("ord"), "signature")))
            kids = below.groupBy("path", "parent_id").agg(F.array_join(F.transform(sort, lambda x: x["signature"]), ",").alias("inner"), F.sum("size").alias("sub"))
            here = here.join(kids.withColumnRenamed("parent_id", "node_id"), ["path", "node_id"], "left")
        else:
            here = here.withColumn("inner", F.lit(None).cast("string")).withColumn("sub", F.lit(None).cast("long"))
        signature = F.when(F.col("inner").isNull(), F.col("name")).otherwise(F.concat("name", F.lit("("), "inner", F.lit(")")))
        # written, so that a level's plan does not hold those below it again
        below = written(here.select("path", "node_id", "parent_id", "ord", "depth", signature.alias("signature"), (F.coalesce("sub", F.lit(0)) + 1).alias("size")))
        done = below if done is None else done.unionByName(below)
    return done.drop("parent_id", "ord")


def duplicate_subtrees(nodes: DataFrame, least: int = 3, dialect: str = "rs") -> DataFrame:
    """(signature, size, n): rs takes all subtrees with ordered children, ts whole trees with sorted children."""
    trees = tree_signatures(nodes, ordered=dialect == "rs")
    trees = trees if dialect == "rs" else trees.where("depth = 0")
    return trees.where(F.col("size") >= least).groupBy("signature").agg(F.first("size").alias("size"), F.count("*").alias("n")).where("n > 1").orderBy(F.desc(F.col("size") * F.col("n")), "signature")


def depth_violations(nodes: DataFrame, most: int = 5, dialect: str = "rs") -> DataFrame:
    """(path[, root_id], depth) of UI trees deeper than ``most`` (a root has depth 1)."""
    keys = ["path"] if dialect == "rs" else ["path", "root_id"]
    return nodes.groupBy(*keys).agg((F.max("depth") + 1).alias("depth")).where(F.col("depth") > most)


def deepest_paths(nodes: DataFrame, most: int = 5, dialect: str = "rs") -> DataFrame:
    """depth_violations() with ``deepest``, the names from the root to the deepest node, and ``deepest_line``.

    The deepest node (of equals the first) of each tree is found by a combined aggregate; then all trees climb one parent per
    step by an equi-join.  nodes needs line, too.
    """
    keys = ["path"] if dialect == "rs" else ["path", "root_id"]
    sign = F.lit(" > " if dialect == "rs" else " -> ")
    place = F.struct((-F.col("depth")).alias("d"), F.col("ord"), F.col("node_id"))
    best = nodes.groupBy(*keys).agg((F.max("depth") + 1).alias("depth"), F.min_by(F.struct("parent_id", "name", "line"), place).alias("n")).where(F.col("depth") > most)
    climb = written(best.select(*keys, "depth", F.col("n.name").alias("deepest"), F.col("n.line").alias("deepest_line"), F.col("n.parent_id").alias("up")))
    above = written(nodes.join(climb.select("path").distinct(), "path", "left_semi").select("path", F.col("node_id").alias("up"), F.col("parent_id").alias("next"), F.col("name").alias("upper")))
    steps = climb.agg(F.max("depth")).first()[0] or 1
    for step in range(1, steps):
        climb = climb.join(above, ["path", "up"], "left").select(*keys, "depth", F.coalesce(F.concat("upper", sign, "deepest"), "deepest").alias("deepest"), "deepest_line", F.col("next").alias("up"))
        if step % 8 == 0:
            climb = written(climb)
    return climb.select(*keys, "depth", "deepest", "deepest_line")


# fixed values: types and parts of names of fields that a class must release, whatever their case
HELD_TYPES = ("TextEditingController", "AnimationController", "ScrollController", "TabController", "PageController", "StreamSubscription", "FocusNode", "ChangeNotifier", "Timer")
HELD_NAMES = ("controller", "subscription")


def leaking_fields(properties: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """(path, parent, name, type, has_release): the second dialect's leaks, by the fields of classes.

    properties: path, parent, name, type; functions: path, parent, name.  A field that must be released leaks where its class has
    no releasing method, or where no code of the file releases it.
    """
    either = F.lower(F.concat_ws(" ", "type", "name"))
    fields = properties.where("parent is not null").where(_holds(either, [t.lower() for t in HELD_TYPES]) | _holds(F.lower("name"), HELD_NAMES)).select("path", "parent", "name", F.coalesce("type", F.lit("Controller")).alias("type"))
    able = functions.where(F.col("name").isin(*RELEASES) & F.col("parent").isNotNull()).select("path", "parent", F.lit(True).alias("able")).distinct()
    done = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(rf"\b(\w+)\s*\.\s*{_one_of(RELEASES)}\s*\("), F.lit(1)))).alias("name"), F.lit(True).alias("done"))
    j = fields.join(able.hint("merge"), ["path", "parent"], "left").join(done.hint("merge"), ["path", "name"], "left")
    return j.where("able is null or done is null").select("path", "parent", "name", "type", F.col("able").isNotNull().alias("has_release"))


def leak_candidates(files: DataFrame) -> DataFrame:
    """(path, name, type) of resources that a stateful file makes and never releases."""
    asked = files.where(F.contains("content", F.lit("State<")))
    found = []
    for kind in RESOURCES:
        made = F.regexp_extract_all("content", F.lit(rf"\b([A-Za-z_]\w*)\s*=\s*{kind}\b"), F.lit(1))
        held = F.regexp_extract_all("content", F.lit(rf"(?:late\s+)?(?:final\s+)?{kind}\s*(?:<[^>]+>)?\??\s+([A-Za-z_]\w*)\s*(?:;|=)"), F.lit(1))
        found.append(_typed(F.array_union(made, held), kind))
    rows = asked.select("path", "content", F.explode(F.flatten(F.array(*found))).alias("r"))
    released = reduce(lambda a, b: a | b, [F.contains("content", F.concat(F.col("r.name"), F.lit(f"{q}.{c}("))) for c in RELEASES for q in ("", "?", "!")])
    return rows.where(~released).groupBy("path", F.col("r.name").alias("name")).agg(F.min("r.type").alias("type"))


def _typed(names: Column, kind: str) -> Column:
    return F.transform(names, lambda v: F.struct(v.alias("name"), F.lit(kind).alias("type")))


def unused_assets(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Assets (path, size) whose path or file name no string of the code names.

    Quoted strings of the code are exploded once and anti-joined by equality of the path, its parts from each
    folder on, and the bare name, in place of a scan of all code for each asset.
    """
    strings = files.select(F.explode(F.regexp_extract_all("content", F.lit(r"""['"]([^'"\n]{1,400})['"]"""), F.lit(1))).alias("s")).select(F.regexp_replace("s", "^/+", "").alias("s")).distinct()
    named = strings.select(F.explode(F.array_distinct(F.array("s", F.substring_index("s", "/", -1)))).alias("key")).distinct()
    keys = assets.select("path", "size", F.explode(F.array_distinct(F.array("path", F.substring_index("path", "/", -1)))).alias("key"))
    used = keys.join(named, "key", "left_semi").select("path").distinct()
    return assets.join(used, "path", "left_anti")


# fixed values: endings of assets and of the code that may name them, in the second dialect
ASSET_ENDINGS, NAMING_CODE = ("png", "jpg", "jpeg", "svg", "webp", "gif", "json", "riv", "ttf", "otf", "mp3", "wav", "flac"), ("dart", "ts", "tsx", "js", "jsx", "kt", "java")
_STEM = 5


def declared_paths(files: DataFrame) -> DataFrame:
    """(declared): files and folders of the asset list of the manifest."""
    from lodestrata.operators.lines import lines

    rows = lines(files.where(F.col("path") == "pubspec.yaml"))
    section = F.last(F.nullif(F.regexp_extract("text", r"^\s*([\w-]+):", 1), F.lit("")), True).over(Window.partitionBy("path").orderBy("line"))
    item = F.regexp_extract("text", r"^\s*-\s*([^\s#]+)", 1)
    return rows.select(section.alias("section"), item.alias("item")).where("section = 'assets' and item != ''").select(F.rtrim(F.lit("/"), F.col("item")).alias("declared")).distinct()


def declared_assets(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Assets (path, size) that the manifest lists or has in a listed folder; all below assets/ where there are none."""
    known = assets.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*ASSET_ENDINGS))
    parts = F.split("path", "/")
    tops = known.select("path", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("declared"))
    listed = tops.join(declared_paths(files), "declared", "left_semi").select("path", "size").distinct()
    return known.where(F.startswith("path", F.lit("assets/"))).select("path", "size") if listed.isEmpty() else listed


def unnamed_assets(assets: DataFrame, files: DataFrame) -> DataFrame:
    """The second dialect's unused assets (path, size): no code holds the file's name, or its stem if that has 5 characters or more.

    Text that holds the path or the name holds the stem as well, so one key is asked for each asset; the keys meet the code by an automaton.
    """
    name = F.element_at(F.split("path", "/"), -1)
    bare = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    keys = assets.select("path", "size", F.when(F.char_length(bare) >= _STEM, bare).otherwise(name).alias("key"))
    code = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*NAMING_CODE) & F.col("path").rlike("^(lib|src)/"))
    used = keys_within(code.select(F.col("content").alias("text")), keys)
    return keys.join(used, "key", "left_anti").select("path", "size")


def asset_report(found: DataFrame, unused: DataFrame) -> DataFrame:
    """One row: the number of assets, of unused ones, and the bytes of these."""
    total = found.agg(F.count("*").alias("assets"))
    return total.join(unused.agg(F.count("*").alias("unused"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes")))


# ---- architecture layers: fixed values, first fitting layer wins ----------------------------------------
LAYERS = {
    "rs": (
        ("domain", "domain entities usecases use_cases"),
        ("data", "data datasources repositories models dto"),
        ("presentation", "presentation ui screens pages views widgets bloc cubit controllers providers"),
        ("core", "core common shared utils theme config"),
    ),
    "ts": (
        ("presentation", "presentation views pages screens ui widgets"),
        ("domain", "domain usecases entities bloc cubit"),
        ("data", "data models datasources network services repositories"),
        ("core", "core utils common constants theme"),
    ),
}
FORBIDDEN = {"rs": (("domain", ("data", "presentation")), ("data", ("presentation",))), "ts": (("domain", ("presentation", "data")),)}
# fixed values: default dependency rules
RULES = (
    ("Domain Purity", "domain", ("data", "presentation")),
    ("Data Independence", "data", ("presentation",)),
    ("Core Isolation", "core", ("presentation", "data")),
)


def layer_of(path: Column, dialect: str = "rs", has_widgets: Column | None = None) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = None
    for layer, names in LAYERS[dialect]:
        hit = p.rlike(f"/({'|'.join(names.split())})/")
        out = F.when(hit, layer) if out is None else out.when(hit, layer)
    if dialect == "ts" and has_widgets is not None:
        out = out.when(has_widgets, "presentation")
    return out.otherwise("other")


def layer_violations(edges: DataFrame, dialect: str = "rs") -> DataFrame:
    """Edges (src, dst, src_layer, dst_layer) that a layer may not have."""
    bad = reduce(lambda a, b: a | b, [(F.col("src_layer") == s) & F.col("dst_layer").isin(*d) for s, d in FORBIDDEN[dialect]])
    return edges.where(bad)


def rule_violations(edges: DataFrame, rules=RULES) -> DataFrame:
    """(rule, src, dst): edges whose source is of a rule's layer (or names it in its path) and whose target is forbidden.

    The few rules are literals of the plan: each edge is tested in place, without a join.
    """
    found = []
    for name, layer, forbidden in rules:
        source = (F.col("src_layer") == layer) | F.contains(F.lower("src"), F.lit(layer.lower()))
        target = reduce(lambda a, b: a | b, [(F.col("dst_layer") == x) | F.contains(F.lower("dst"), F.lit(x.lower())) for x in forbidden])
        found.append(F.when(source & target, F.lit(name)))
    return edges.select(F.explode(F.array_compact(F.array(*found))).alias("rule"), "src", "dst")


# fixed values: default dependency rules of the second dialect
RULES_TS = (
    ("Domain Layer Isolation", "domain", ("data", "presentation", "ui")),
    ("Core Isolation", "core", ("features", "modules", "pages", "screens")),
    ("Clean Presentation", "presentation", ("data/datasources", "data/models")),
)


def segment_violations(edges: DataFrame, rules=RULES_TS) -> DataFrame:
    """(rule, src, dst, forbidden): edges from a rule's folder to a forbidden one; names must be whole folders of the path."""
    inside = lambda c, name: F.contains(F.concat(F.lit("/"), F.lower(F.replace(F.col(c), F.lit("\\"), F.lit("/"))), F.lit("/")), F.lit(f"/{name.lower()}/"))
    found = [F.when(inside("src", layer) & inside("dst", x), F.struct(F.lit(name).alias("rule"), F.lit(x).alias("forbidden"))) for name, layer, forbidden in rules for x in forbidden]
    return edges.select("src", "dst", F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.rule", "src", "dst", "f.forbidden")


def layer_report(nodes: DataFrame, edges: DataFrame, dialect: str = "rs") -> DataFrame:
    """(layer, files, instability): counts and mean instability (rs rounds the mean to 2 places, ts all to 3)."""
    digits = 3 if dialect == "ts" else 12
    return coupling(edges, nodes, digits).groupBy("layer").agg(F.count("*").alias("files"), F.round(F.avg("instability"), 3 if dialect == "ts" else 2).alias("instability"))


def precision_recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of two sets of keys; one full join."""
    a, b = found.select(*keys).distinct().withColumn("f", F.lit(1)), truth.select(*keys).distinct().withColumn("t", F.lit(1))
    j = a.join(b, keys, "full").agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return j.select("tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1"))


# ---- diagnostics: lines of analysers and compilers ---------------------------------------------------------------
# fixed values: severities, in any case, and the description of what has none
SEVERITIES, UNDESCRIBED = ("info", "warning", "error"), "Compilation Issue"


def _severity(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*SEVERITIES), word)


def _diagnostic(severity, description, file, line, col, message) -> Column:
    """A struct of the parts; null where one that is needed is missing."""
    made = F.struct(severity.alias("severity"), F.trim(description).alias("description"), F.trim(file).alias("file"), line.alias("line"), col.alias("col"), F.trim(message).alias("message"))
    return F.when(severity.isNotNull() & line.isNotNull() & col.isNotNull(), made)


def _number(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c).try_cast("int")


def _field(parts: Column, k: int) -> Column:
    return F.get(parts, F.lit(k) if k >= 0 else F.size(parts) + k)


def _bulleted(t: Column) -> Column:
    """severity, description, file:line:col and code, with a bullet or hyphen between."""
    parts = F.split(F.trim(t), r"\s+[•-]\s+")
    place = F.array_position(F.transform(parts, lambda x: x.rlike(r":[0-9]+:[0-9]+$")), True).cast("int") - 1
    at = F.split(F.get(parts, place), ":")
    middle, tail = F.array_join(F.slice(parts, 2, F.greatest(place - 1, F.lit(0))), " - "), F.array_join(F.slice(parts, place + 2, F.size(parts)), " - ")
    return F.when((place >= 2) & (F.size(parts) > place + 1), _diagnostic(_severity(_field(parts, 0)), middle, F.array_join(F.slice(at, 1, F.size(at) - 2), ":"), _number(_field(at, -2)), _number(_field(at, -1)), tail))


def _bracketed(t: Column) -> Column:
    """file(line,col): severity TScode: message."""
    head, rest = F.substring_index(t, "): ", 1), F.split(t, r"\): ", 2)
    place, said = F.split(F.substring_index(head, "(", -1), ","), F.split(F.get(rest, F.lit(1)), ": ", 2)
    words = F.split(F.get(said, F.lit(0)), r"\s+")
    code = _field(words, 1)
    one = _diagnostic(_severity(_field(words, 0)), code, F.substring_index(head, "(", 1), _number(_field(place, 0)), _number(_field(place, 1)), F.get(said, F.lit(1)))
    return F.when((F.size(words) == 2) & F.startswith(code, F.lit("TS")) & (F.size(place) == 2) & F.get(said, F.lit(1)).isNotNull(), one)


def _coloned(t: Column) -> Column:
    """file:line: severity: message."""
    parts = F.split(t, ": ", 3)
    place = F.split(F.get(parts, F.lit(0)), ":")
    one = _diagnostic(_severity(_field(parts, 1)), F.lit(UNDESCRIBED), F.array_join(F.slice(place, 1, F.size(place) - 1), ":"), _number(_field(place, -1)), F.lit(1), _field(parts, 2))
    return F.when((F.size(parts) == 3) & (F.size(place) >= 2), one)


def diagnostics(rows: DataFrame, text: str = "text") -> DataFrame:
    """severity, description, file, line, col, message of the tool output lines that are diagnostics; the first form that fits counts."""
    t = F.rtrim(F.col(text))
    keep = [c for c in rows.columns if c != text]
    return rows.select(*keep, F.coalesce(_bulleted(t), _bracketed(t), _coloned(t)).alias("d")).where("d is not null").select(*keep, "d.*")


def parity_matrix(found: DataFrame, engines: list[str]) -> DataFrame:
    """(metric, one count per engine) of symbols (engine, metric, name); no engine missing."""
    m = found.groupBy("metric").pivot("engine", engines).agg(F.countDistinct("name"))
    return m.select("metric", *[F.coalesce(e, F.lit(0)).alias(e) for e in engines])


def only_in(found: DataFrame, engine: str, other: str) -> DataFrame:
    """Symbols (metric, name) that one engine finds and the other does not."""
    part = lambda e: found.where(F.col("engine") == e).select("metric", "name").distinct()
    return part(engine).join(part(other), ["metric", "name"], "left_anti")
