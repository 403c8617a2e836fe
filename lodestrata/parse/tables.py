"""Parsed corpora as tables: one pass over the files, one row for each symbol, split by kind."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.parse.languages import parse

_TEXTS = "parent type extends_class value alias receiver caller_function context comment target on accessor body_hash".split()
_LISTS = "mixins implements values show hide".split()
_FLAGS = "is_abstract is_async is_static is_factory is_const is_final is_top_level is_private".split()
_NUMBERS = "body_length node_id parent_id root_id depth ord".split()
SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("line_end", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in _TEXTS] + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS]
    + [T.StructField(c, T.BooleanType()) for c in _FLAGS] + [T.StructField(c, T.IntegerType()) for c in _NUMBERS]
)
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def parsed(files: DataFrame) -> DataFrame:
    """Symbols of files (path, content): project only these columns first; parsing is row-local.

    Rows go out in batches of bounded size.  A file that cannot be parsed gives none.
    """
    kinds = {f.name: _ARROW[f.dataType.simpleString()] for f in SCHEMA}

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for r in parse(path or "", text or ""):
                    if (hidden := r.pop("hidden", None)) is not None:
                        r["is_private"] = hidden
                    r["path"] = path
                    rows.append(r)
                if len(rows) > 20_000:
                    yield _batch(rows, kinds)
                    rows = []
            yield _batch(rows, kinds)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    known = set().union(*rows)
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) if c in known else pa.nulls(len(rows), t) for c, t in kinds.items()], list(kinds))


def of_kind(symbols: DataFrame, kind: str) -> DataFrame:
    return symbols.where(F.col("kind") == kind)


def symbol_spans(symbols: DataFrame) -> DataFrame:
    """(path, kind, name, parent, line, line_end, ord) for span queries; methods are functions with a parent."""
    rows = symbols.where(F.col("kind").isin("class", "function", "enum", "mixin", "extension", "typedef"))
    kind = F.when((F.col("kind") == "function") & F.col("parent").isNotNull(), "method").otherwise(F.col("kind"))
    rank = F.array_position(F.array(*map(F.lit, ("class", "method", "function", "enum", "mixin", "extension", "typedef"))), kind)
    return rows.select("path", kind.alias("kind"), "name", "parent", "line", "line_end", (rank * 10_000_000 + F.col("line")).alias("ord"))


def quick_outline(symbols: DataFrame) -> DataFrame:
    """Classes (by their type), top-level functions, enums and mixins by line."""
    rows = symbols.where("kind in ('class', 'enum', 'mixin') or (kind = 'function' and parent is null)")
    return rows.select("path", "name", F.when(F.col("kind") == "class", F.col("type")).otherwise(F.col("kind")).alias("kind"), "line", "line_end").orderBy("path", "line")


def search_docs(symbols: DataFrame) -> DataFrame:
    """Documents of the ranked symbol search: id, name, path, superclass, comments, kind."""
    named = symbols.where(F.col("kind").isin("class", "function", "enum", "mixin", "extension", "extension_type", "typedef", "variable", "property", "constructor", "annotation"))
    key = F.concat_ws(":", "path", "kind", F.concat_ws(".", "parent", "name"), F.col("line").cast("string"))
    return named.select(key.alias("id"), "kind", "name", "path", F.col("extends_class").alias("superclass"), F.col("comment").alias("comments"))


def translation_docs(translations: DataFrame) -> DataFrame:
    """search_docs() of locale entries: the key is the name, the first 100 characters of the value the comment."""
    none = F.lit(None).cast("string")
    return translations.select(F.concat_ws(":", "path", F.lit("translation"), "key").alias("id"), F.lit("translation").alias("kind"), F.col("key").alias("name"), "path", none.alias("superclass"), F.substring("value", 1, 100).alias("comments"))


def symbol_counts(symbols: DataFrame, files: DataFrame, translations: DataFrame | None = None) -> DataFrame:
    """One row of counters of the second dialect; methods count as functions."""
    several = {"classes": "class", "functions": "function", "widgets": "widget", "enums": "enum", "mixins": "mixin", "calls": "call", "extensions": "extension", "typedefs": "typedef", "variables": "variable", "constructors": "constructor", "properties": "property", "annotations": "annotation", "extension_types": "extension_type"}
    roots = lambda kind: F.col("depth") == 0 if kind == "widget" else F.lit(True)
    row = symbols.agg(*[F.count_if((F.col("kind") == kind) & roots(kind)).alias(c) for c, kind in several.items()])
    entries = F.lit(0).cast("long") if translations is None else None
    total = files.agg(F.count("*").alias("files"))
    out = total.join(row)
    return out.withColumn("translations", entries) if translations is None else out.join(translations.agg(F.count("*").alias("translations")))


def _named(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind in ('class', 'function', 'enum', 'mixin', 'extension', 'typedef', 'variable', 'property') and name != ''").select("kind", "name", F.col("path").alias("def_path"), F.col("line").alias("def_line")).distinct()


def usages(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, name, def_path, used_in, times): whole-word uses of defined names, other than on their own lines."""
    from lodestrata.operators.lines import lines

    words = lines(files).select(F.col("path").alias("used_in"), "line", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))).alias("name"))
    words = words.groupBy("used_in", "line", "name").agg(F.count("*").alias("times"))
    named = _named(symbols)
    hit = words.join(named, "name").where("not (used_in = def_path and line = def_line)")
    return hit.groupBy("kind", "name", "def_path", "used_in").agg(F.sum("times").alias("times"))


def usage_places(symbols: DataFrame, files: DataFrame, spans: DataFrame, dialect: str = "rs") -> DataFrame:
    """(name, used_in, line, times, class, function) of every line that has a defined name as a whole word, other than a definition of it, with the class and the
    innermost function or method around it.

    spans: as ``symbol_spans`` gives them.  Uses meet names, not definitions, so a name that many files define makes no pairs.
    """
    from lodestrata.operators.lines import lines
    from lodestrata.operators.spans import class_at, node_at

    words = lines(files).select(F.col("path").alias("used_in"), "line", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))).alias("name"))
    words = words.groupBy("used_in", "line", "name").agg(F.count("*").alias("times"))
    named = _named(symbols)
    own = named.select(F.col("def_path").alias("used_in"), F.col("def_line").alias("line"), "name").distinct()
    hit = words.join(named.select("name").distinct(), "name", "left_semi").join(own, ["used_in", "line", "name"], "left_anti")
    cursors = hit.select(F.col("used_in").alias("path"), F.col("line").alias("at")).distinct()
    inside = node_at(spans.where(F.col("kind").isin("function", "method")), cursors, dialect).select(F.col("path").alias("used_in"), F.col("at").alias("line"), F.col("name").alias("function"))
    classes = class_at(spans.where("kind = 'class'").select("path", "name", "line", "line_end"), cursors).select(F.col("path").alias("used_in"), F.col("at").alias("line"), "class")
    return hit.join(classes, ["used_in", "line"], "left").join(inside, ["used_in", "line"], "left").select("name", "used_in", "line", "times", "class", "function")


def usage_counts(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, name, def_path, usage_count): how many files have the name on another line than the definition's.

    Counted by name, without the pairs of definitions and uses: all files that have the name, less the definition's own file
    where only the defining line has it.
    """
    from lodestrata.operators.lines import lines

    words = lines(files).select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("name"))
    own = words.groupBy("path", "name").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    total = own.groupBy("name").agg(F.count("*").alias("files"))
    named = _named(symbols).groupBy("kind", "name", "def_path").agg(F.min("def_line").alias("def_line"))
    # texts of a small table look small enough for a broadcast, however many words they have: never through the driver
    j = named.join(total.hint("merge"), "name", "left").join(own.withColumnRenamed("path", "def_path").hint("merge"), ["def_path", "name"], "left")
    alone = F.coalesce((F.col("n") == 1) & (F.col("first") == F.col("def_line")), F.lit(False)).cast("long")
    return j.select("kind", "name", "def_path", (F.coalesce("files", F.lit(0)) - alone).alias("usage_count"))


def users_of(symbols: DataFrame, found: DataFrame, name: str, kind: str, parent: str | None = None) -> DataFrame:
    """(def_path, used_in, times): files that use an element of a kind, from usages(); a parent class narrows functions and properties."""
    mine = symbols.where((F.col("kind") == kind) & (F.col("name") == name))
    if kind in ("function", "property", "constructor"):
        mine = mine.where(F.col("parent").isNull() if parent is None else F.col("parent") == parent)
    places = mine.select(F.col("path").alias("def_path")).distinct()
    return found.where((F.col("kind") == kind) & (F.col("name") == name)).join(places, "def_path", "left_semi").select("def_path", "used_in", "times")


#: Blocks of definitions that meet the uses one after the other.
_BLOCKS = 64


def naming(files: DataFrame, name: str) -> DataFrame:
    """Files that hold a name anywhere: only these can define or use it, so only these need be parsed for it."""
    return files.select("path", "content").where(F.contains("content", F.lit(name)))


def users_in(symbols: DataFrame, files: DataFrame, name: str, kind: str, parent: str | None = None) -> DataFrame:
    """users_of() of one element, straight from the files: (def_path, used_in, times).

    Definitions and uses are counted by file before they meet, so their pairs, which are the result, are neither shuffled nor aggregated; the uses are dealt out, as
    all have one name, and the definitions in blocks, so that a file that the result is written to repeats few paths near each other and stays small.
    """
    from lodestrata.operators.lines import lines

    spark = symbols.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mine = symbols.where((F.col("kind") == kind) & (F.col("name") == name))
    held = mine.where(F.col("parent").isNull() if parent is None else F.col("parent") == parent) if kind in ("function", "property", "constructor") else mine
    # the definitions' lines in the files that hold the element, as usages() takes them
    places = _named(mine).join(held.select(F.col("path").alias("def_path")).distinct().hint("merge"), "def_path", "left_semi")
    # a file without the name anywhere has no line with it
    near = naming(files, name)
    words = lines(near).select(F.col("path").alias("used_in"), "line", F.size(F.filter(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)), lambda w: w == name)).alias("times")).where("times > 0")
    uses = words.groupBy("used_in").agg(F.sum("times").alias("all_times"))
    own = places.join(words.select(F.col("used_in").alias("def_path"), F.col("line").alias("def_line"), "times").hint("merge"), ["def_path", "def_line"], "left")
    defined = own.groupBy("def_path").agg(F.countDistinct("def_line").alias("n"), F.coalesce(F.sum("times"), F.lit(0)).alias("own"))
    dealt = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = uses.withColumn("deal", F.pmod(F.hash("used_in"), F.lit(parts))).withColumn("block", dealt(_BLOCKS))
    right = defined.withColumn("deal", dealt(parts)).withColumn("block", F.pmod(F.hash("def_path"), F.lit(_BLOCKS)))
    times = F.col("n") * F.col("all_times") - F.when(F.col("used_in") == F.col("def_path"), F.col("own")).otherwise(0)
    return left.hint("merge").join(right, ["deal", "block"]).select("def_path", "used_in", times.alias("times")).where("times > 0")


def global_stats(symbols: DataFrame, files: DataFrame, dialect: str = "rs") -> DataFrame:
    """One row of counts."""
    n = lambda c: F.count_if(F.expr(c))
    s = symbols.agg(n("kind = 'class' and type != 'widget'").alias("classes"), n("kind = 'class' and type = 'widget'").alias("widgets"), n("kind = 'function'").alias("functions"), n("kind = 'function' and parent is not null").alias("methods"), n("kind = 'enum'").alias("enums"), n("kind = 'mixin'").alias("mixins"), n("kind = 'extension'").alias("extensions"), n("kind = 'import'").alias("imports"), n("kind = 'widget' and depth = 0").alias("root_widgets"))
    f = files.agg(F.count("*").alias("files"), F.sum(F.size(F.split("content", "\n")) - F.when(F.endswith("content", F.lit("\n")), 1).otherwise(0)).alias("lines"))
    columns = ["files", "lines", "classes", "widgets", "functions", "enums"] if dialect == "rs" else ["files", *s.columns]
    return f.join(s).select(*columns)
