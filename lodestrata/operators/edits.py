"""Edits of file contents as column functions; the result is a new version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(content: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    return F.when(F.char_length(needle) > 0, F.floor((F.char_length(content) - F.char_length(F.replace(content, needle, F.lit("")))) / F.char_length(needle)).cast("int")).otherwise(0)


def replaced(files: DataFrame, old: str, new: str, replace_all: bool = False, expected: int | None = None) -> DataFrame:
    """files with ``content`` edited, ``replacements`` and ``error``.

    Without replace_all the old text must occur exactly once (or as often as expected); else the content stays.
    Line ends follow the file: a file with CRLF is matched and edited with CRLF.
    """
    crlf = F.contains("content", F.lit("\r\n"))
    fit = lambda s: F.when(crlf, F.lit(s.replace("\r\n", "\n").replace("\n", "\r\n"))).otherwise(F.lit(s.replace("\r\n", "\n")))
    rows = files.withColumn("_old", fit(old)).withColumn("_new", fit(new)).withColumn("_n", occurrences(F.col("content"), F.col("_old")))
    want = F.col("_n") if replace_all and expected is None else F.lit(expected if expected is not None else 1)
    error = F.when(F.col("_n") == 0, "not found").when(F.col("_n") != want, F.concat(F.lit("found "), F.col("_n").cast("string"), F.lit(" times")))
    edited = F.when(error.isNull(), F.replace("content", F.col("_old"), F.col("_new"))).otherwise(F.col("content"))
    return rows.withColumn("error", error).withColumn("replacements", F.when(error.isNull(), F.col("_n")).otherwise(0)).withColumn("content", edited).drop("_old", "_new", "_n")


def lines_replaced(files: DataFrame, start: int, end: int, text: str, guard: str | None = None) -> DataFrame:
    """files with the lines start to end (from 1, both included) replaced by a text; ``guard`` must stand in them."""
    parts = F.split("content", "\n", -1)
    n = F.size(parts)
    old = F.array_join(F.slice(parts, start, max(0, end - start + 1)), "\n")
    bad = F.when((F.lit(start) < 1) | (F.lit(end) < F.lit(start)) | (n < end), "outside the file")
    if guard is not None:
        bad = bad.when(~F.contains(old, F.lit(guard)), "guard not found")
    after = F.slice(parts, end + 1, F.greatest(n - end, F.lit(0)))
    middle = F.lit(text.split("\n")) if text else F.array().cast("array<string>")
    joined = F.array_join(F.concat(F.slice(parts, 1, start - 1), middle, after), "\n")
    return files.withColumn("error", bad).withColumn("content", F.when(bad.isNull(), joined).otherwise(F.col("content")))


def written_files(files: DataFrame, fresh: DataFrame) -> DataFrame:
    """files with whole contents (path, content) put in place of or beside the old ones."""
    return files.join(fresh.select("path"), "path", "left_anti").select("path", "content").unionByName(fresh.select("path", "content"))


def text_style(content: Column) -> Column:
    """indent (its unit, two spaces where no line shows one), eol, and whether the last line ends, of a JSON text."""
    first = F.regexp_extract(content, r'(?m)^([ \t]+)"', 1)
    unit = F.when(first == "", "  ").when(F.contains(first, F.lit("\t")), "\t").otherwise(first)
    eol = F.when(F.contains(content, F.lit("\r\n")), "\r\n").otherwise("\n")
    return F.struct(unit.alias("indent"), eol.alias("eol"), ((content == "") | F.endswith(content, F.lit("\n"))).alias("ended"))


def styled(text: Column, style: Column) -> Column:
    """A text with two spaces a level and plain line ends, in the style of another one."""
    level = lambda line: (F.char_length(F.regexp_extract(line, "^ *", 0)) / 2).cast("int")
    lines = F.transform(F.split(F.regexp_replace(text, "\\n+$", ""), "\n"), lambda line: F.concat(F.repeat(style["indent"], level(line)), F.regexp_replace(line, "^ +", "")))
    whole = F.concat(F.array_join(lines, "\n"), F.when(style["ended"], "\n").otherwise(""))
    return F.replace(whole, F.lit("\n"), style["eol"])


def rewritten(files: DataFrame, fresh: DataFrame, suffix: str = ".bak") -> DataFrame:
    """files with JSON contents (path, content) put in place in the style of the old file, whose text is kept under path + suffix."""
    old = files.join(fresh.select("path", F.col("content").alias("_new")), "path")
    done = old.select("path", styled(F.col("_new"), text_style(F.col("content"))).alias("content"))
    kept = old.select(F.concat("path", F.lit(suffix)).alias("path"), "content")
    added = fresh.join(files.select("path"), "path", "left_anti").select("path", "content")
    both = done.unionByName(kept).unionByName(added)
    return files.join(both.select("path"), "path", "left_anti").select("path", "content").unionByName(both)
