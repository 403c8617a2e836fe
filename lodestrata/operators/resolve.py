"""Resolution joins: import specifiers to files, and calls to definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.paths import dirname, extension, normalized, posix
from lodestrata.operators.substrings import pairs_within
from lodestrata.sources.shared import written

# fixed values: suffixes that may complete a specifier, in the order they are tried
SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".dart", ".kt", ".java")
INDEXES = tuple(f"/index{s}" for s in SUFFIXES[:8])


def dart_target(path: Column, spec: Column, package: Column) -> Column:
    """Dialect rs: a file for own-package and relative specifiers, else null."""
    own = F.concat(F.lit("package:"), package, F.lit("/"))
    inside = F.concat(F.lit("lib/"), F.substring(spec, F.char_length(own) + 1, F.lit(1 << 20)))
    relative = normalized(F.concat(dirname(path), F.lit("/"), spec))
    return F.when(F.startswith(spec, F.lit("dart:")), None).when(F.startswith(spec, own), inside).when(F.startswith(spec, F.lit("package:")), None).otherwise(relative)


def resolve_imports(imports: DataFrame, files: DataFrame, package: str | None = None, aliases: tuple = ()) -> DataFrame:
    """imports (path, spec) with ``target``: the first candidate, in order, that is a file; null for external ones.

    Distinct (path, spec) pairs are resolved once; candidates are exploded with their order and met by an equi-join, so
    the work is linear in the imports.  aliases: (prefix, replacement), longest prefix first.
    """
    asked = imports.select("path", "spec").where("spec is not null and trim(spec) != ''").distinct()
    p, s = posix(F.col("path")), F.trim("spec")
    here = dirname(p)
    scheme = s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    base = F.when(F.startswith(s, F.lit("package:")), F.when(F.startswith(s, F.lit(f"package:{package}/")), F.concat(F.lit("lib/"), F.regexp_extract(s, "^package:[^/]+/(.+)$", 1))) if package else F.lit(None))
    base = base.when(scheme, None).when(F.startswith(s, F.lit(".")), F.concat(here, F.lit("/"), s)).when(F.startswith(s, F.lit("/")), F.regexp_replace(s, "^/+", ""))
    for prefix, replacement in sorted(aliases, key=lambda a: -len(a[0])):
        base = base.when(F.startswith(s, F.lit(prefix)), F.concat(F.lit(replacement), F.substring(s, len(prefix) + 1, 1 << 20)))
    base = normalized(base.when(extension(p) == "dart", F.concat(here, F.lit("/"), s)))
    dotted = extension(p).isin("kt", "java") & s.rlike(r"^[\w.]+$") & F.contains(s, F.lit("."))
    script = F.regexp_extract(F.col("base"), r"^(.*)\.(?:js|jsx|mjs|cjs)$", 1)
    options = [F.col("base"), *[F.when(script != "", F.concat(script, F.lit(x))) for x in (".ts", ".tsx")], *[F.concat("base", F.lit(x)) for x in (*SUFFIXES, *INDEXES)]]
    rows = asked.withColumn("base", base).withColumn("tail", F.when(dotted, F.replace(s, F.lit("."), F.lit("/"))))
    index = files.select(F.col("path").alias("target"), posix(F.col("path")).alias("key"))
    tried = rows.where("base is not null").select("path", "spec", F.posexplode(F.array(*options)).alias("ord", "key")).where("key is not null")
    direct = tried.join(index.hint("merge"), "key").groupBy("path", "spec").agg(F.min_by("target", F.struct("ord", "target")).alias("target"))
    # qualified names: the file's own trailing path parts are the key, so this is an equi-join too
    parts = F.split(F.regexp_replace("key", r"\.(kt|java)$", ""), "/")
    tails = index.where(extension(F.col("key")).isin("kt", "java")).select("target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))).alias("tail"))
    qualified = rows.where("tail is not null").join(tails, "tail").groupBy("path", "spec").agg(F.min("target").alias("target"))
    return imports.join(direct.unionByName(qualified).groupBy("path", "spec").agg(F.min("target").alias("target")).hint("merge"), ["path", "spec"], "left")


def first_definition(names: DataFrame, definitions: DataFrame) -> DataFrame:
    """names (name) with the first definition (path, line) of each name."""
    first = definitions.groupBy("name").agg(F.min(F.struct("path", "line")).alias("d")).select("name", F.col("d.path").alias("def_path"), F.col("d.line").alias("def_line"))
    return names.join(first, "name", "left")


def resolve_calls(calls: DataFrame, functions: DataFrame, classes: DataFrame, ancestry: DataFrame, imported: DataFrame) -> DataFrame:
    """calls (path, line, name, receiver, caller_class) with ``target`` (``file:Class.member`` or ``file:name``) and ``how``.

    In order: method of this or super's ancestry; method of the receiver's class (by name, or by the variable form
    of it), or the class itself; function of the same file; method of the caller's own ancestry; function of an imported
    file; class as constructor; the only function of that name anywhere.  functions: path, name, parent_class; classes:
    path, name; ancestry: node, ancestor, depth (a class is its own ancestor at 0); imported: path, target.
    """
    # written, so every branch reads the same numbers; joined by shuffles, as rows made of a small table look small enough for a broadcast
    call = written(calls.withColumn("call", F.monotonically_increasing_id()), "calls")
    own = functions.where("parent_class is not null").select(F.col("parent_class").alias("c"), F.col("name").alias("m"), F.concat("path", F.lit(":"), "parent_class", F.lit("."), "name").alias("q"))
    free = functions.where("parent_class is null").select(F.col("path").alias("fp"), F.col("name").alias("fn"), F.concat("path", F.lit(":"), "name").alias("q")).distinct()
    made = classes.groupBy("name").agg(F.min("path").alias("cp")).select(F.col("name").alias("cn"), F.concat("cp", F.lit(":"), "name").alias("q"))
    line = ancestry.select(F.col("node").alias("start"), F.col("ancestor").alias("c"), "depth")
    bare = F.regexp_replace("receiver", r"^[_$]+", "")
    typed = F.when(F.col("receiver").isin("this", "super"), F.array("caller_class")).when(F.col("receiver").isNotNull(), F.array_distinct(F.array("receiver", bare, F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 20))))).otherwise(F.array("caller_class"))
    starts = call.select("call", F.col("name").alias("m"), "receiver", F.posexplode(typed).alias("form", "start")).where("start is not null")
    method = starts.join(line.hint("merge"), "start").join(own.hint("merge"), ["c", "m"]).where("not (receiver <=> 'super' and depth = 0)").groupBy("call").agg(F.min(F.struct("form", "depth", "q")).alias("b")).select("call", F.col("b.q").alias("q_method"))
    kind = starts.where("receiver is not null and receiver not in ('this', 'super')").join(made.withColumnRenamed("cn", "start").hint("merge"), "start").groupBy("call").agg(F.min(F.struct("form", "q")).alias("b")).select("call", F.col("b.q").alias("q_class"))
    plain = call.where("receiver is null")
    same = plain.join(free.hint("merge"), (plain["path"] == free["fp"]) & (plain["name"] == free["fn"])).groupBy("call").agg(F.min("q").alias("q_same"))
    # by file and name at once: a file that all others import has its calls dealt by their names
    through = plain.join(imported.select(F.col("path").alias("ip"), F.col("target").alias("fp")).hint("merge"), F.col("path") == F.col("ip")).withColumnRenamed("name", "fn").join(free.hint("merge"), ["fp", "fn"]).groupBy("call").agg(F.min("q").alias("q_import"))
    ctor = plain.join(made.hint("merge"), plain["name"] == made["cn"]).groupBy("call").agg(F.min("q").alias("q_ctor"))
    only = free.groupBy("fn").agg(F.count("*").alias("n"), F.min("q").alias("q_only")).where("n = 1")
    alone = plain.join(only.hint("merge"), plain["name"] == only["fn"]).select("call", "q_only")
    for part in (method, kind, same, through, ctor, alone):
        call = call.join(part.hint("merge"), "call", "left")
    with_receiver = F.coalesce("q_method", F.when(~F.col("receiver").isin("this", "super"), F.col("q_class")))
    target = F.when(F.col("receiver").isNotNull(), with_receiver).otherwise(F.coalesce("q_same", "q_method", "q_import", "q_ctor", "q_only"))
    how = F.when(F.col("receiver").isNotNull(), F.when(F.col("q_method").isNotNull(), "method").when(with_receiver.isNotNull(), "class"))
    how = how.when(F.col("q_same").isNotNull(), "same_file").when(F.col("q_method").isNotNull(), "method").when(F.col("q_import").isNotNull(), "import").when(F.col("q_ctor").isNotNull(), "constructor").when(F.col("q_only").isNotNull(), "unique")
    return call.select(*calls.columns, target.alias("target"), how.alias("how"))


def propagate_usage(usages: DataFrame, resolved: DataFrame) -> DataFrame:
    """(kind, name, def_path, used_in): files that import a definition's file count as users of it."""
    direct = usages.select("kind", "name", "def_path", "used_in")
    via = usages.select("kind", "name", "def_path").distinct().join(resolved.where("target is not null").select(F.col("target").alias("def_path"), F.col("path").alias("used_in")), "def_path")
    return direct.unionByName(via.select("kind", "name", "def_path", "used_in")).where("used_in is not null").distinct()


def loose_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, spec, target) by the loose rule: the file's path ends with the specifier, or the specifier holds the file's stem.

    Distinct specifiers meet distinct stems only: ends of paths by equality, stems inside specifiers by an automaton.
    """
    from lodestrata.functions.paths import stem

    specs = imports.select("spec").where("spec is not null and spec != ''").distinct()
    known = files.select(F.col("path").alias("target"), stem(F.col("path")).alias("stem"))
    parts = F.split("target", "/")
    tails = known.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))).alias("spec"))
    stems = known.select(F.col("stem").alias("key")).where("key != ''")
    held = pairs_within(specs.select(F.col("spec").alias("text")), stems).join(known, F.col("key") == F.col("stem")).select(F.col("text").alias("spec"), "target")
    pairs = tails.join(specs, "spec", "left_semi").select("spec", "target").unionByName(held).distinct()
    return imports.select("path", "spec").distinct().join(pairs, "spec").where("path != target").select("path", "spec", "target")
