"""File scans: source trees, locale files, and JSON fallback caches, as (path, content) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.paths import CODE_EXTENSIONS, excluded, extension

SKIPPED_FOLDERS = ("node_modules", "build", "target")
LOCALE_DEPTH = 8
# fixed values: further folders that hold no locale files of the project
NO_LOCALES = ("ios", "android", "macos", "windows", "linux", "Pods", "out", "dist")


def _hidden(path: Column) -> Column:
    return path.rlike(rf"(^|/)(\.[^/]+|{'|'.join(SKIPPED_FOLDERS)})/")


def scan(spark: SparkSession, root: str, extensions: tuple = CODE_EXTENSIONS, exclude: tuple = (), glob: str | None = None) -> DataFrame:
    """(path relative to root, content, hash) of the files below a root with one of the extensions.

    Hidden and build folders are skipped.  Names are filtered before contents are decoded.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace("path", r"^(?:[a-z0-9]+:)?/*" + _quoted(base.split(":", 1)[-1].lstrip("/")) + "/", "")
    rows = rows.withColumn("path", path).where(~_hidden(F.col("path")))
    if extensions:
        rows = rows.where(extension(F.col("path")).isin(*extensions))
    if exclude:
        rows = rows.where(~excluded(F.col("path"), list(exclude)))
    return rows.select("path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("updated_at")).withColumn("hash", F.md5("content"))


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.+*?^${}()|[]" else c for c in s)


def locale_files(spark: SparkSession, root: str) -> DataFrame:
    """Locale files below a root, to a depth, outside hidden, build and platform folders."""
    parts = F.split("path", "/")
    return scan(spark, root, (), glob="*.arb").where((F.size(parts) <= LOCALE_DEPTH) & ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, NO_LOCALES))))


def project_mode(paths: DataFrame, dialect: str = "rs") -> str:
    """flutter, android, web or unknown, from the marker files of a scan."""
    marks = paths.agg(
        F.max(F.col("path") == "pubspec.yaml").alias("flutter"),
        F.max(F.col("path").rlike(r"^(app/)?build\.gradle(\.kts)?$|^settings\.gradle(\.kts)?$")).alias("android"),
        F.max(F.col("path").isin("package.json", "tsconfig.json")).alias("web"),
    ).first()
    order = ("flutter", "android", "web") if dialect == "rs" else ("flutter", "web", "android")
    return next((m for m in order if marks[m]), "unknown")


def mode_files(files: DataFrame, mode: str) -> DataFrame:
    """The files that a project of a mode is indexed by."""
    roots = {"flutter": r"^(lib|android/app)/", "android": r"^(app|src)/", "web": r"^(src|app|pages|components|lib)/|^[^/]+$"}
    return files.where(F.col("path").rlike(roots[mode])) if mode in roots else files


# fixed values: where a search without an index looks, and the scripts of the top folder that count
SEARCH_FOLDERS, SEARCHED = ("lib", "android/app/src/main", "src", "app"), ("dart", "kt", "java", "ts", "tsx", "js", "jsx")
TOP_SCRIPTS, SCRIPTS = ("App", "index", "main"), ("ts", "tsx", "js", "jsx")


def direct_search_files(files: DataFrame) -> DataFrame:
    """The files that a search without an index reads."""
    ext = F.element_at(F.split("path", r"\."), -1)
    below = F.col("path").rlike(rf"^({'|'.join(SEARCH_FOLDERS)})/") & ext.isin(*SEARCHED) & F.contains("path", F.lit("."))
    return files.where(below | F.col("path").isin(*[f"{n}.{e}" for n in TOP_SCRIPTS for e in SCRIPTS]))


def under(files: DataFrame, path: str | None) -> DataFrame:
    """A file, or all files below a folder; all without a path."""
    if not path:
        return files
    p = path.rstrip("/")
    return files.where((F.col("path") == p) | F.startswith("path", F.lit(p + "/")))


def json_cache(spark: SparkSession, path: str) -> DataFrame:
    """(path, data) of a JSON fallback cache {files: {path: record}}; entries that are no objects are skipped."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json(F.get_json_object("value", "$.dartFiles"), "map<string,string>")).alias("path", "data"))
    return rows.where(F.startswith(F.ltrim("data"), F.lit("{")))


def with_fallback(*tables: DataFrame | None) -> DataFrame | None:
    """The first table that is there and not empty."""
    return next((t for t in tables if t is not None and not t.isEmpty()), None)


def porcelain_paths(rows: DataFrame, text: str = "text") -> DataFrame:
    """(path) of changed files from version-control status or name-only lines; a rename counts by its new name."""
    line = F.regexp_replace(F.col(text), r"^(?:[ MADRCU?!]{2} )", "")
    path = F.trim(F.regexp_replace(F.element_at(F.split(line, " -> "), -1), '"', ""))
    return rows.select(path.alias("path")).where("path != ''").distinct()


def analysis_excludes(files: DataFrame) -> DataFrame:
    """(path, line, glob) that an analysis_options.yaml excludes: the items of ``exclude:`` within its section ``analyzer:``, in
    a block or in brackets.  A block ends at a line that is no item and stands no deeper than its key."""
    from lodestrata.operators.lines import lines

    t = F.trim("text")
    rows = lines(files.where(F.col("path").rlike(r"(^|/)analysis_options\.yaml$"))).where((t != "") & ~F.startswith(t, F.lit("#")))
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    indent = F.char_length(F.regexp_extract("text", r"^\s*", 0))
    head = F.when(F.startswith(t, F.lit("analyzer:")), True).when(indent == 0, False)
    rows = rows.select("path", "line", t.alias("t"), indent.alias("indent"), F.last(head, True).over(upto).alias("inside")).where("inside")
    key = F.startswith("t", F.lit("exclude:"))
    rows = rows.withColumn("key", F.last(F.when(key, F.struct("line", "indent")), True).over(upto)).where("key is not null")
    item = F.startswith("t", F.lit("-"))
    ends = ~key & ~item & (F.col("indent") <= F.col("key.indent"))
    rows = rows.withColumn("ended", F.coalesce(F.last(F.when(ends, F.col("line")), True).over(upto), F.lit(0)))
    listed = F.regexp_extract("t", r"^exclude:\s*\[(.*)\]", 1)
    open_block = item & (F.col("ended") < F.col("key.line")) & ~F.col("bracketed")
    rows = rows.withColumn("bracketed", F.last(F.when(key, listed != ""), True).over(upto))
    found = F.when(key & (listed != ""), F.split(listed, ",")).when(open_block, F.array(F.substring("t", 2, 1 << 30)))
    plain = F.regexp_replace(F.trim(F.col("g")), "^['\"]|['\"]$", "")
    return rows.select("path", "line", F.explode(found).alias("g")).select("path", "line", plain.alias("glob")).where("glob != ''")


def without_excluded(files: DataFrame) -> DataFrame:
    """files less those that the project's own analysis options exclude (one small configuration file, read on the driver)."""
    globs = [r["glob"] for r in analysis_excludes(files.where(F.col("path") == "analysis_options.yaml")).orderBy("line").collect()]
    return files.where(~excluded(F.col("path"), globs))
