"""Package lists from lock files and manifests: (name, version, source, dependency_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.lines import lines

COLUMNS = "name version source dependency_type".split()


def pubspec_lock(files: DataFrame) -> DataFrame:
    """Entries of pubspec.lock: a name line (two spaces) opens an entry, its fields follow deeper."""
    rows = lines(files.where(F.col("path").rlike(r"(^|/)pubspec\.lock$")))
    w = Window.partitionBy("path").orderBy("line")
    name = F.regexp_extract("text", r"^  ([A-Za-z_]\w*):\s*$", 1)
    top = F.regexp_extract("text", r"^(\w+):", 1)
    rows = rows.withColumn("name", F.last(F.nullif(name, F.lit("")), True).over(w)).withColumn("section", F.last(F.nullif(top, F.lit("")), True).over(w)).where("section = 'packages' and name is not null")
    field = lambda key: F.first(F.nullif(F.regexp_extract("text", rf'^\s+{key}:\s*"?([^"]+?)"?\s*$', 1), F.lit("")), True)
    out = rows.groupBy("path", "name").agg(field("version").alias("version"), field("source").alias("source"), field("dependency").alias("dependency_type"))
    return out.select(*COLUMNS)


def pubspec_sections(files: DataFrame) -> DataFrame:
    """Direct dependencies of pubspec.yaml by section."""
    rows = lines(files.where(F.col("path").rlike(r"(^|/)pubspec\.yaml$")))
    w = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("section", F.last(F.nullif(F.regexp_extract("text", r"^(\w+):", 1), F.lit("")), True).over(w))
    rows = rows.where(F.col("section").isin("dependencies", "dev_dependencies") & F.col("text").rlike(r"^  [A-Za-z_]\w*:"))
    kind = F.when(F.col("section") == "dependencies", "direct main").otherwise("direct dev")
    version = F.nullif(F.regexp_extract("text", r"^  \w+:\s*\"?'?([^\"'#]*?)\"?'?\s*(?:#.*)?$", 1), F.lit(""))
    return rows.select(F.regexp_extract("text", r"^  (\w+):", 1).alias("name"), F.coalesce(version, F.lit("any")).alias("version"), F.lit("manifest").alias("source"), kind.alias("dependency_type"))


def package_lock(files: DataFrame) -> DataFrame:
    """Entries of package-lock.json: version 2 ``packages`` (not nested ones), else version 1 ``dependencies``."""
    entry = "map<string,struct<version:string,dev:boolean>>"
    rows = files.where(F.col("path").rlike(r"(^|/)package-lock\.json$")).select(F.from_json("content", f"packages {entry}, dependencies {entry}").alias("j"))
    v2 = rows.select(F.explode("j.packages").alias("k", "v")).where(F.col("k").rlike(r"^node_modules/((?!node_modules/).)+$")).select(F.regexp_replace("k", "^node_modules/", "").alias("name"), "v")
    v1 = rows.where("j.packages is null").select(F.explode("j.dependencies").alias("name", "v"))
    both = v2.unionByName(v1)
    return both.select("name", F.col("v.version").alias("version"), F.lit("npm").alias("source"), F.when(F.col("v.dev"), "direct dev").otherwise("direct main").alias("dependency_type"))


def package_json(files: DataFrame) -> DataFrame:
    rows = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select(F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    main = rows.select(F.explode("j.dependencies").alias("name", "version"), F.lit("direct main").alias("dependency_type"))
    dev = rows.select(F.explode("j.devDependencies").alias("name", "version"), F.lit("direct dev").alias("dependency_type"))
    return main.unionByName(dev).select("name", "version", F.lit("npm").alias("source"), "dependency_type")


def gradle(files: DataFrame) -> DataFrame:
    """Coordinates and catalogue aliases of build.gradle(.kts); the first mention of a name wins."""
    rows = lines(files.where(F.col("path").rlike(r"(^|/)build\.gradle(\.kts)?$")))
    p = r"^\s*(implementation|api|compileOnly|runtimeOnly|kapt|ksp|testImplementation|androidTestImplementation|debugImplementation)\b[\s(]*(?:platform\()?"
    coordinate, alias = p + r"[\"']([^\"':]+:[^\"':]+)(?::([^\"']+))?[\"']", p + r"(libs\.[\w.]+)"
    name = F.coalesce(F.nullif(F.regexp_extract("text", coordinate, 2), F.lit("")), F.nullif(F.regexp_extract("text", alias, 2), F.lit("")))
    kind = F.regexp_extract("text", p, 1)
    found = rows.select("path", "line", name.alias("name"), F.coalesce(F.nullif(F.regexp_extract("text", coordinate, 3), F.lit("")), F.lit("any")).alias("version"), F.when(F.contains(F.lower(kind), F.lit("test")), "direct dev").otherwise("direct main").alias("dependency_type")).where("name is not null")
    first = found.groupBy("name").agg(F.min_by(F.struct("version", "dependency_type"), F.struct("path", "line")).alias("v"))
    return first.select("name", "v.version", F.lit("gradle").alias("source"), "v.dependency_type")


def all_packages(files: DataFrame) -> DataFrame:
    """The first kind of list that has entries: lock files before manifests."""
    from lodestrata.sources.files import with_fallback

    kinds = (pubspec_lock, package_lock, package_json, gradle)
    return with_fallback(*[k(files) for k in kinds]) or pubspec_sections(files)


def package_config(files: DataFrame) -> DataFrame:
    """(name, root) of .dart_tool/package_config.json."""
    rows = files.where(F.col("path").rlike(r"(^|/)package_config\.json$"))
    p = rows.select(F.explode(F.from_json("content", "packages array<struct<name:string,rootUri:string,packageUri:string>>")["packages"]).alias("p"))
    return p.select("p.name", F.url_decode(F.concat_ws("/", F.rtrim("p.rootUri"), F.col("p.packageUri"))).alias("root"))


def read_package_uri(config: DataFrame, files: DataFrame, uri: str) -> DataFrame:
    """The file that a package: URI names."""
    name, rest = uri.removeprefix("package:").split("/", 1)
    root = F.regexp_replace("root", "/+$", "")
    return files.join(F.broadcast(config.where(F.col("name") == name).select(F.concat(root, F.lit("/" + rest)).alias("path"))), "path", "left_semi")


def packages_where(packages: DataFrame, dependency_type: str | None = None, source: str | None = None) -> DataFrame:
    """Packages of a type of dependency and a source, where these are named."""
    for column, want in (("dependency_type", dependency_type), ("source", source)):
        packages = packages.where(F.col(column) == want) if want else packages
    return packages


def read_package_source(config: DataFrame, files: DataFrame, uri: str, start: int = 1, count: int = 100) -> DataFrame:
    """(path, line, text): lines of the file that a package: URI names, from ``start`` on."""
    rows = lines(read_package_uri(config, files, uri))
    return rows.where(F.col("line").between(max(1, start), max(1, start) + count - 1)).orderBy("line")


def manifest_warnings(packages: DataFrame) -> DataFrame:
    """(name, warning) of dependencies without a version bound."""
    return packages.where("version is null or version in ('any', '*', 'latest')").select("name", F.lit("unbounded version").alias("warning"))


def manifest_report(files: DataFrame) -> DataFrame:
    """(path, warning, name) of pubspec.yaml: dependencies of any version, no description, no SDK constraint."""
    own = files.where(F.col("path").rlike(r"(^|/)pubspec\.yaml$"))
    rows = lines(own)
    w = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("section", F.last(F.nullif(F.regexp_extract("text", r"^(\w+):", 1), F.lit("")), True).over(w))
    entry = F.col("section").isin("dependencies", "dev_dependencies") & F.col("text").rlike(r"^  [A-Za-z_]\w*\s*:\s*(any\s*)?$")
    loose = rows.where(entry).select("path", F.lit("any version").alias("warning"), F.regexp_extract("text", r"^  (\w+)", 1).alias("name"))
    said = rows.groupBy("path").agg(F.bool_or(F.col("text").rlike(r"^description:\s*\S")).alias("described"), F.bool_or((F.col("section") == "environment") & F.col("text").rlike(r"^\s+sdk:\s*\S")).alias("bounded"))
    lacks = F.array_compact(F.array(F.when(~F.coalesce("described", F.lit(False)), F.lit("no description")), F.when(~F.coalesce("bounded", F.lit(False)), F.lit("no sdk constraint"))))
    return loose.unionByName(own.select("path").join(said, "path", "left").select("path", F.explode(lacks).alias("warning"), F.lit(None).cast("string").alias("name")))
