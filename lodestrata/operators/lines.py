"""Line-level queries: slices, text and regex search, whole-word references, blocks and fragments.

``lines`` is the common form: (path, line, text), one row per line, numbered from 1.  Everything here is row-local or an
equi-join on the path with a residual range predicate.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.lexical import block_ends, matches
from lodestrata.operators.spans import with_ends


def lines(files: DataFrame, dialect: str = "rs", keep: tuple = ()) -> DataFrame:
    """Explode content into lines.  rs drops the empty line after a final newline, ts keeps it."""
    content = F.col("content") if dialect == "ts" else F.regexp_replace("content", r"\r?\n\z", "")
    rows = files.select("path", *keep, F.posexplode(F.split(content, "\n")).alias("pos", "text"))
    return rows.select("path", *keep, (F.col("pos") + 1).alias("line"), F.regexp_replace("text", r"\r$", "").alias("text"))


def read_lines(files: DataFrame, path: str, start: int = 1, end: int | None = None, most: int = 100) -> DataFrame:
    last = min(end, start + most - 1) if end else start + most - 1
    return lines(files.where(F.col("path") == path)).where(F.col("line").between(max(1, start), last)).orderBy("line")


def pattern_or_literal(query: str, regex: bool) -> str:
    """The pattern of a query; an invalid one is taken literally."""
    if not regex:
        return re.escape(query)
    try:
        re.compile(query)
        return query
    except re.error:
        return re.escape(query)


def search_text(rows: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False, k: int = 100, per_match: bool = False, comments: bool = True, strings: bool = True) -> DataFrame:
    """Lines (or matches) with a text or pattern, in order of path and line, at most k.

    Without comments or strings the matches outside them, by the state of the lines (``lexical.matches``), with the place of each.
    """
    if not (comments and strings):
        found = matches(rows, ("" if case_sensitive else "(?i)") + pattern_or_literal(query, regex), comments, strings)
        found = found if per_match else found.select("path", "line").distinct().join(rows, ["path", "line"]).select(*rows.columns)
        return found.orderBy("path", "line", *(["n"] if per_match else [])).limit(k)
    p = ("" if case_sensitive else "(?i)") + pattern_or_literal(query, regex)
    if not regex:
        hit = F.contains("text", F.lit(query)) if case_sensitive else F.contains(F.lower("text"), F.lit(query.lower()))
    else:
        hit = F.col("text").rlike(p)
    found = rows.where(hit)
    if per_match:
        found = found.select("path", "line", "text", F.posexplode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("n", "match"), _in_comment(F.col("text")).alias("comment"))
        return found.orderBy("path", "line", "n").limit(k)
    return found.orderBy("path", "line").limit(k)


def _in_comment(text: Column) -> Column:
    return F.ltrim(text).rlike(r"^(//|/\*|\*|#|<!--)")


def word_references(rows: DataFrame, symbol: str, k: int | None = None) -> DataFrame:
    """(path, line, text, hits) of lines with the symbol as a whole word."""
    p = rf"\b{re.escape(symbol)}\b"
    found = rows.where(F.contains("text", F.lit(symbol))).where(F.col("text").rlike(p))
    found = found.withColumn("hits", F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))).orderBy("path", "line")
    return found.limit(k) if k else found


def references(calls: DataFrame, classes: DataFrame, rows: DataFrame, symbol: str) -> DataFrame:
    """Calls, derivations and whole-word hits of a symbol, one for each (path, line): the more exact kind wins."""
    call = calls.where(F.col("name") == symbol).select("path", "line", F.lit("call").alias("kind"), F.lit(0).alias("rank"))
    base = F.concat(F.array("extends_class"), F.coalesce("mixins", F.array().cast("array<string>")), F.coalesce("implements", F.array().cast("array<string>")))
    derived = classes.where(F.array_contains(base, symbol)).select("path", "line", F.lit("derives").alias("kind"), F.lit(1).alias("rank"))
    word = word_references(rows, symbol).select("path", "line", F.lit("word").alias("kind"), F.lit(2).alias("rank"))
    both = call.unionByName(derived).unionByName(word)
    return both.groupBy("path", "line").agg(F.min_by("kind", "rank").alias("kind")).orderBy("path", "line")


def code_blocks(symbols: DataFrame, rows: DataFrame, name: str, dialect: str = "rs") -> DataFrame:
    """Source of every symbol of a name: its lines, joined on the path and cut to its span.

    An unknown end is that of the symbol's kind (rs), or found by the balance of braces in code (ts, which gives no block where that finds none).
    """
    named = symbols.where(F.col("name") == name)
    if dialect == "ts":
        ends = block_ends(named.where("line_end is null"), rows).withColumnRenamed("line_end", "found")
        named = named.join(ends, ["path", "line"], "left").withColumn("line_end", F.coalesce("line_end", "found")).drop("found").where("line_end is not null")
    s = with_ends(named, dialect).select(F.col("path").alias("p"), "kind", "name", "parent", F.col("line").alias("first"), "line_end")
    joined = s.join(rows, (F.col("p") == rows["path"]) & rows["line"].between(F.col("first"), F.col("line_end")))
    return joined.groupBy("path", "kind", "name", "parent", "first", "line_end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("source"))


#: Which kind of symbol a fragment is taken from first.
KIND_PRIORITY = ("class", "method", "function", "enum")


def fragment(symbols: DataFrame, rows: DataFrame, name: str, kind: str | None = None, parent: str | None = None, context: int = 3, dialect: str = "rs") -> DataFrame:
    """The first symbol of a name by kind priority and path, with the comment lines above it and context lines."""
    rank = F.array_position(F.array(*map(F.lit, KIND_PRIORITY)), F.col("kind"))
    s = with_ends(symbols, dialect).where((F.col("name") == name) & (rank > 0))
    s = s.where(F.col("kind") == kind) if kind else s
    s = s.where(F.col("parent") == parent) if parent else s
    one = s.orderBy(rank, "path", "line").limit(1).select(F.col("path").alias("p"), "kind", F.col("line").alias("first"), "line_end")
    near = rows.join(F.broadcast(one), rows["path"] == F.col("p")).where(F.col("line") <= F.col("line_end") + context)
    comment = F.trim("text").rlike(r"^(///|//|/\*|\*|@)")
    # the run of comment lines that ends right above the symbol: no other line lies between
    up = Window.partitionBy("path").orderBy(F.desc("line"))
    above = near.where(F.col("line") < F.col("first")).withColumn("other", F.sum(F.when(comment, 0).otherwise(1)).over(up))
    doc = above.where((F.col("other") == 0) | (F.col("line") >= F.col("first") - context)).drop("other")
    body = near.where(F.col("line") >= F.col("first"))
    part = F.when(F.col("line") < F.col("first"), F.when(comment, "doc").otherwise("before")).when(F.col("line") > F.col("line_end"), "after").otherwise("body")
    return doc.unionByName(body).select("path", "kind", "line", part.alias("part"), "text").orderBy("line")


#: Lines of a body whose end is unknown.
FLOW_LINES = {"method": 35, "function": 35}
# fixed values: what marks a step.  A step's kind is the first rule that fits the trimmed line: (kind, how, needles).
_STEPS = (
    ("loop", "starts", ("for ", "for(", "while ")),
    ("state_update", "has", ("setState", "emit(", "state =", "notifyListeners()")),
    ("api_call", "has", ("http.", "dio.", "Firebase", "Supabase")),
    ("data_fetch", "has", ("Hive", "SharedPreferences", "sqflite")),
    ("notification", "has", ("Navigator.", "context.go(", "context.push(", "showDialog", "showSnackBar")),
)
_BRANCH, _GUARD = ("if ", "if(", "else if", "switch"), ("== null", ".isEmpty", "!mounted")


def _any(how: str, c: Column, needles) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | (F.startswith(c, F.lit(n)) if how == "starts" else F.contains(c, F.lit(n)))
    return found


def step_kind(text: Column) -> Column:
    """Kind of logic step of a line, or null."""
    t = F.trim(text)
    kind = F.when((t == "") | F.startswith(t, F.lit("//")), None).when(_any("starts", t, _BRANCH), F.when(_any("has", t, _GUARD), "validation").otherwise("conditional"))
    for name, how, needles in _STEPS:
        kind = kind.when(_any(how, t, needles), name)
    errors = _any("starts", t, ("try", "catch", "throw ")) | F.contains(t, F.lit(" catch "))
    return kind.when(errors, "error_handling").when(F.startswith(t, F.lit("return ")) | (t == "return;"), "return")


def logic_flow(rows: DataFrame, keys: tuple = ("path",)) -> DataFrame:
    """(keys, step, line, kind, code) of the steps of each function body given as lines."""
    steps = rows.withColumn("kind", step_kind(F.col("text"))).where("kind is not null")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("line"))
    return steps.select(*keys, number.alias("step"), "line", "kind", F.substring(F.trim("text"), 1, 120).alias("code"))


def flow_summary(rows: DataFrame, keys: tuple = ("path",)) -> DataFrame:
    """(keys, steps, complexity, awaits): branches, loops and catches add to a complexity of 1."""
    t = F.trim("text")
    code = (t != "") & ~F.startswith(t, F.lit("//"))
    kind = step_kind(F.col("text"))
    adds = kind.isin("validation", "conditional", "loop") | ((kind == "error_handling") & F.contains(t, F.lit("catch")))
    return rows.where(code).groupBy(*keys).agg(F.count(kind).alias("steps"), (F.count_if(adds) + 1).alias("complexity"), F.count_if(F.contains("text", F.lit("await "))).alias("awaits"))


#: Definition patterns of a search without an index: kind and the pattern whose first group is the name.
DEFINITIONS = (
    ("class", r"\b(?:abstract\s+)?class\s+([A-Za-z_]\w*)"),
    ("enum", r"\benum\s+(?:class\s+)?([A-Za-z_]\w*)"),
    ("mixin", r"\bmixin\s+([A-Za-z_]\w*)"),
    ("extension", r"\bextension\s+([A-Za-z_]\w*)\s+on\b"),
    ("interface", r"\binterface\s+([A-Za-z_]\w*)"),
    ("typedef", r"\btypedef\s+([A-Za-z_]\w*)"),
    ("function", r"\bfun(?:ction)?\s+([A-Za-z_]\w*)\s*\("),
    ("variable", r"\b(?:final|const|var|val|let)\s+(?:[A-Za-z_][\w<>?]*\s+)?([A-Za-z_]\w*)\s*="),
    ("import", r"^\s*import\s+['\"]([^'\"]+)['\"]"),
)


#: Words that stand before a parenthesis or a name without being a type.
_NO_TYPES = ("return", "new", "await", "throw", "else", "case", "in", "is", "as", "if", "for", "while", "switch", "catch", "import", "export", "typedef", "class", "enum", "mixin", "extension", "fun", "function", "yield", "assert", "delete", "typeof", "instanceof")
_MODIFIERS = ("static", "public", "private", "protected", "internal", "export", "default", "abstract", "external", "override", "final", "const", "late", "synchronized", "async", "open", "inline", "suspend")


def _typed_function(text: Column) -> Column:
    """The name of a function that a line declares by a type in front of it, as ``void helper() {``: two words or more before a parenthesis, of which the one in front of
    the name is a type, and no statement's word; empty without one."""
    head = F.trim(F.substring_index(text, "(", 1))
    words = F.filter(F.split(F.regexp_replace(head, "<.*>", ""), r"[\s?]+"), lambda w: (w != "") & ~w.isin(*_MODIFIERS))
    name, kind = F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(-2))
    plain = F.forall(words, lambda w: w.rlike(r"^[A-Za-z_][\w.\[\],]*$") & ~w.isin(*_NO_TYPES))
    fits = F.contains(text, F.lit("(")) & plain & kind.isNotNull() & name.rlike(r"^[A-Za-z_]\w*$")
    return F.when(F.coalesce(fits, F.lit(False)), name).otherwise("")


def direct_definitions(rows: DataFrame, query: str, k: int | None = 50, kind: str | None = None) -> DataFrame:
    """Definitions by pattern, straight from lines: (path, line, kind, name), of one kind where it is named."""
    kinds = [F.struct(F.lit(name).alias("kind"), F.regexp_extract("text", p, 1).alias("name")) for name, p in DEFINITIONS if kind in (None, name)]
    kinds += [F.struct(F.lit("function").alias("kind"), _typed_function(F.col("text")).alias("name"))] if kind in (None, "function") else []
    if not kinds:
        return rows.select("path", "line", F.lit("").alias("kind"), F.lit("").alias("name")).limit(0)
    found = F.array_distinct(F.array(*kinds))
    rows = rows.where(F.contains(F.lower("text"), F.lit(query.lower())))
    hits = rows.select("path", "line", F.explode(found).alias("d")).select("path", "line", "d.kind", "d.name")
    hits = hits.where((F.col("name") != "") & F.contains(F.lower("name"), F.lit(query.lower()))).orderBy("path", "line", "kind")
    return hits if k is None else hits.limit(k)


def reverse_import_lines(rows: DataFrame, target: str) -> DataFrame:
    """First import, export or part line of each file that names the target."""
    name = target.rsplit("/", 1)[-1]
    hit = F.ltrim("text").rlike(r"^(import|export|part) ") & F.contains("text", F.lit(name))
    return rows.where(hit).groupBy("path").agg(F.min("line").alias("line"), F.min_by("text", "line").alias("text"))


def with_context(rows: DataFrame, around: int = 1) -> DataFrame:
    """Lines with ``context``: the lines around each, joined."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(-around, around)
    return rows.withColumn("context", F.array_join(F.collect_list("text").over(w), "\n"))


def direct_calls(rows: DataFrame, query: str, k: int | None = 50) -> DataFrame:
    """Call sites by pattern, straight from lines: a name that holds the query before an opening parenthesis, and no definition."""
    name = F.regexp_extract("text", rf"(?i)\b([A-Za-z_]\w*{re.escape(query)}\w*|{re.escape(query)}\w*)\s*\(", 1)
    defined = F.col("text").rlike(r"\b(class|fun|function|def|enum|mixin)\s")
    hits = rows.where(F.contains(F.lower("text"), F.lit(query.lower())) & ~defined & ~_in_comment(F.col("text"))).select("path", "line", name.alias("name")).where("name != ''").orderBy("path", "line")
    return hits if k is None else hits.limit(k)
