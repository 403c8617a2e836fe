"""Ranked search: BM25 over weighted fields, name boosts, and the orders of result lists.

Without an index scoring needs no shuffle of the corpus: a document's length and the frequencies of the few
query terms are row-local; one aggregation brings the corpus statistics, and the best rows are taken
with a bounded sort.  ``indexed`` makes an inverted index as two tables, which ``reindexed`` and ``unindexed`` keep up to date
and ``search_index`` reads: the rows of the query's terms and the table of lengths, not the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.tokens import ascii_lower, ascii_tokens, query_tokens, unicode_tokens

K1, B, IDF_FLOOR = 1.5, 0.75, 0.1
FIELDS = ("name", "path", "superclass", "comments")


@dataclass(frozen=True)
class Dialect:
    name: str
    weights: dict = field(hash=False, default_factory=dict)
    boosts: tuple = ()
    limit: int = 50

    def tokens(self, c) -> Column:
        return ascii_tokens(c) if self.name == "ts" else unicode_tokens(c)

    def lower(self, c: Column) -> Column:
        return F.lower(c) if self.name == "ts" else ascii_lower(c)


_COMMON = {"name": 4.0, "path": 1.5, "superclass": 2.0}
DIALECTS = {
    "ts": Dialect("ts", {**_COMMON, "comments": 0.3}, (10.0, 5.0, 2.0)),
    "rs": Dialect("rs", {**_COMMON, "comments": 0.5}, (10.0, 4.0, 1.5)),
}


def _total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _present(docs: DataFrame) -> list[str]:
    return [c for c in FIELDS if c in docs.columns]


def _length(d: Dialect, sizes: dict[str, Column]) -> Column:
    return _total([n * F.lit(d.weights[c]) for c, n in sizes.items()])


def _occurrences(docs: DataFrame, dialect: str, *kept: str) -> DataFrame:
    """(kept columns, dl, term, w) for each token of each document: the document's length and the weight of the token's field.  Fields are tokenised once."""
    d, fields = DIALECTS[dialect], _present(docs)
    rows = docs.select(*kept, *[d.tokens(c).alias(f"_{c}") for c in fields])
    sizes = {c: F.size(f"_{c}") for c in fields}
    rows = rows.select(*kept, _length(d, sizes).alias("dl"), *[n.alias(f"n_{c}") for c, n in sizes.items()], F.posexplode(F.concat(*[f"_{c}" for c in fields])).alias("pos", "term"))
    weight = F.lit(d.weights[fields[-1]])
    for i in range(len(fields) - 2, -1, -1):
        weight = F.when(F.col("pos") < _total([F.col(f"n_{c}") for c in fields[: i + 1]]), d.weights[fields[i]]).otherwise(weight)
    return rows.select(*kept, "dl", "term", weight.alias("w"))


def weighted_terms(docs: DataFrame, dialect: str = "ts") -> DataFrame:
    """(id, term, tf): weighted frequencies of all terms."""
    return _occurrences(docs, dialect, "id").groupBy("id", "term").agg(F.sum("w").alias("tf"))


#: Terms of a batch of rows that posting_blocks() gives out.
_BLOCK_TERMS = 1 << 17


def posting_blocks(docs: DataFrame, dialect: str, bucket: Callable[[Column], Column]) -> DataFrame:
    """(id, name, dl, bucket, terms, tfs): the distinct terms of each document with their weighted frequencies, in one row for each bucket that it has terms of.

    ``bucket`` gives a term's bucket.  Terms are joined by spaces, which no token has.  Documents are counted where they are read, one at a time, and their
    id, name and length go once with all terms of a bucket, so a shuffle of these rows is small beside one of single terms.  Few partitions are dealt out first.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if 2 * docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores, "id")
    d, fields = DIALECTS[dialect], _present(docs)
    rows = docs.select("id", "name", *[d.tokens(c).alias(f"_{c}") for c in fields])
    length = _length(d, {c: F.size(f"_{c}") for c in fields}).cast("double")
    rows = rows.select("id", "name", length.alias("dl"), *[f"_{c}" for c in fields], *[F.transform(f"_{c}", bucket).alias(f"b_{c}") for c in fields])
    weights = [d.weights[c] for c in fields]
    own = docs.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _blocks(batches, weights), f"id {own}, name string, dl double, bucket int, terms string, tfs array<double>")


def _blocks(batches: Iterator[pa.RecordBatch], weights: list[float]) -> Iterator[pa.RecordBatch]:
    """posting_blocks() of rows (id, name, dl, tokens of each field, their buckets)."""
    lists = lambda column, k: column.values.slice(at := column.offsets[k].as_py(), column.offsets[k + 1].as_py() - at).to_numpy(zero_copy_only=False).tolist()
    for batch in batches:
        row, bucket, terms, tfs, ends = [], [], [], [], [0]

        def out() -> pa.RecordBatch:
            own = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(3)]  # noqa: B023
            weighted = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tfs, pa.float64()))  # noqa: B023
            return pa.RecordBatch.from_arrays([*own, pa.array(bucket, pa.int32()), pa.array(terms, pa.string()), weighted], ["id", "name", "dl", "bucket", "terms", "tfs"])  # noqa: B023

        for r in range(batch.num_rows):
            tf: dict[str, float] = {}
            of: dict[str, int] = {}
            for k, weight in enumerate(weights):
                found = lists(batch.column(3 + k), r)
                of.update(zip(found, lists(batch.column(3 + len(weights) + k), r)))
                for term, n in Counter(found).items():
                    tf[term] = tf.get(term, 0.0) + n * weight
            parts: dict[int, list[str]] = {}
            for term, part in of.items():
                parts.setdefault(part, []).append(term)
            for part, held in parts.items():
                row.append(r)
                bucket.append(part)
                terms.append(" ".join(held))
                tfs.extend([tf[t] for t in held])
                ends.append(len(tfs))
            if len(tfs) >= _BLOCK_TERMS:
                yield out()
                row, bucket, terms, tfs, ends = [], [], [], [], [0]
        yield out()


def doc_lengths(docs: DataFrame, dialect: str = "ts") -> DataFrame:
    """(id, dl): weighted number of tokens; row-local."""
    d = DIALECTS[dialect]
    return docs.select("id", _length(d, {c: F.size(d.tokens(c)) for c in _present(docs)}).alias("dl"))


def idf(n, df) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1), F.lit(IDF_FLOOR))


def idf_table(docs: DataFrame, dialect: str = "ts") -> DataFrame:
    """(term, df, idf) over the corpus."""
    d = DIALECTS[dialect]
    terms = docs.select("id", F.explode(F.array_distinct(F.concat(*[d.tokens(c) for c in _present(docs)]))).alias("term"))
    n = docs.count()
    return terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf(F.lit(float(n)), F.col("df")))


def scored(docs: DataFrame, query: str, dialect: str = "ts", overlap: bool = True) -> DataFrame:
    """(id, name, score, hits) of the candidates: hits is the number of query terms a document has."""
    d, terms = DIALECTS[dialect], query_tokens(query, dialect)
    fields = _present(docs)
    if not terms:
        return docs.select("id", "name", F.lit(0.0).alias("score"), F.lit(0).alias("hits")).limit(0)
    tokens = {c: f"_{c}" for c in fields}
    tf = [_total([F.size(F.filter(a, lambda x: x == F.lit(t))) * F.lit(d.weights[c]) for c, a in tokens.items()]) for t in terms]  # noqa: B023

    def measured(part: DataFrame) -> DataFrame:
        rows = part.select("id", "name", *[d.tokens(c).alias(a) for c, a in tokens.items()])
        m = F.struct(_total([F.size(a) * F.lit(d.weights[c]) for c, a in tokens.items()]).alias("dl"), *[t.alias(f"tf{i}") for i, t in enumerate(tf)])
        # through a generator of one row, so that filters above are not pushed down with a copy of the tokenizer each
        return rows.select("id", "name", F.explode(F.array(m)).alias("m")).select("id", "name", "m.*")

    stats = measured(docs).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    # a document with a term has it as a substring, so only such ones are taken apart again
    whole = F.lower(F.concat_ws("\n", *fields))
    rows = measured(docs.where(reduce(lambda a, b: a | b, [F.contains(whole, F.lit(t)) for t in [*terms, query.strip().lower()]])))
    return _ranked(rows, stats, terms, query, dialect, overlap)


def _ranked(rows: DataFrame, stats, terms: list[str], query: str, dialect: str, overlap: bool) -> DataFrame:
    """(id, name, score, hits) of rows (id, name, dl, tf0, tf1, ...) by the corpus statistics n, avgdl, df0, df1, ..."""
    d = DIALECTS[dialect]
    avg = (stats["avgdl"] or 0.0) + (1e-9 if dialect == "rs" else 0.0)
    norm = F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(avg if avg else 1.0)
    parts = []
    for i in range(len(terms)):
        f, df = F.col(f"tf{i}"), float(stats[f"df{i}"])
        parts.append(F.when(f > 0, idf(F.lit(float(stats["n"])), F.lit(df)) * f * (K1 + 1) / (f + K1 * norm)).otherwise(0.0))
    hits = _total([F.when(F.col(f"tf{i}") > 0, 1).otherwise(0) for i in range(len(terms))])
    name, asked = d.lower(F.col("name")), query.lower() if dialect == "ts" else query.strip().lower()
    exact, prefix, inside = (F.lit(x) for x in d.boosts)
    boost = F.when(name == asked, exact).when(F.startswith(name, F.lit(asked)), prefix).when(F.contains(name, F.lit(asked)), inside).otherwise(0.0)
    least = 2 if dialect == "ts" and overlap and len(terms) > 2 else 1
    candidate = hits >= least
    if dialect == "rs":
        candidate = candidate | F.contains(name, F.lit(asked))
    return rows.withColumn("hits", hits).where(candidate).select("id", "name", (_total(parts) + F.coalesce(boost, F.lit(0.0))).alias("score"), "hits").where("score > 0")


def search(docs: DataFrame, query: str, dialect: str = "ts", k: int = 50) -> DataFrame:
    """The k best documents: score descending, then id (rs: scores rounded to 3 places after sorting)."""
    best = scored(docs, query, dialect).orderBy(F.desc("score"), "id").limit(k)
    return best.select("id", "name", F.round("score", 3).alias("score") if dialect == "rs" else "score")


def indexed(docs: DataFrame, dialect: str = "ts") -> tuple[DataFrame, DataFrame]:
    """The inverted index of documents: postings (term, id, tf) and documents (id, name, dl).

    Write the postings sorted or bucketed by term, so that a search reads the files of its terms only.
    """
    d = DIALECTS[dialect]
    dl = _length(d, {c: F.size(d.tokens(c)) for c in _present(docs)})
    return weighted_terms(docs, dialect).select("term", "id", "tf"), docs.select("id", "name", dl.alias("dl"))


def unindexed(index: tuple[DataFrame, DataFrame], ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index without some documents (id)."""
    return tuple(part.join(ids.select("id").distinct(), "id", "left_anti").select(*part.columns) for part in index)


def reindexed(index: tuple[DataFrame, DataFrame], docs: DataFrame, dialect: str = "ts") -> tuple[DataFrame, DataFrame]:
    """The index after documents were added or changed: their old rows go, only they are tokenised."""
    return tuple(old.unionByName(new) for old, new in zip(unindexed(index, docs), indexed(docs, dialect)))


def search_index(index: tuple[DataFrame, DataFrame], query: str, dialect: str = "ts", k: int = 50) -> DataFrame:
    """search() by an index: one filter on the postings' terms and one pass over the lengths."""
    (postings, documents), terms = index, query_tokens(query, dialect)
    if not terms:
        return documents.select("id", "name", F.lit(0.0).alias("score")).limit(0)
    met = postings.where(F.col("term").isin(*terms)).groupBy("id").agg(*[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(terms)])
    rows = documents.join(met, "id", "left" if dialect == "rs" else "inner").na.fill(0.0, [f"tf{i}" for i in range(len(terms))])
    totals = documents.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    have = {r["term"]: r["df"] for r in postings.where(F.col("term").isin(*terms)).groupBy("term").agg(F.countDistinct("id").alias("df")).collect()}  # one row for each term of the query
    stats = {"n": totals["n"], "avgdl": totals["avgdl"], **{f"df{i}": have.get(t, 0) for i, t in enumerate(terms)}}
    best = _ranked(rows, stats, terms, query, dialect, True).orderBy(F.desc("score"), "id").limit(k)
    return best.select("id", "name", F.round("score", 3).alias("score") if dialect == "rs" else "score")


def symbol_search(symbols: DataFrame, query: str, k: int = 50) -> DataFrame:
    """Symbols whose name contains the query: best score first, then names that begin with it, then by name.

    symbols: id, kind, name and any of the other fields.
    """
    q = query.lower()
    found = symbols.where(F.contains(F.lower("name"), F.lit(q)))
    ranked = found.join(scored(symbols, query, "ts", overlap=False).select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranked.orderBy(F.desc("score"), F.desc(F.startswith(F.lower("name"), F.lit(q))), F.lower("name"), "name", "id").limit(k)


# fixed values: other names of kinds, and the kinds that a search by kind takes
KIND_ALIASES = {"ext": "extension", "type": "typedef", "vars": "variable", "call": "function", "extensionType": "extension_type"}
NAMED_KINDS = ("class", "function", "enum", "mixin", "extension", "extension_type", "typedef", "variable", "constructor", "property", "annotation")


def tool_search(symbols: DataFrame, files: DataFrame, query: str, kind: str | None = None, mode: str = "both", k: int | None = 50, direct: bool = False, docs: DataFrame | None = None) -> DataFrame:
    """(name, type, path, line) of definitions, calls (mode ``definitions``, ``calls`` or ``both``) and files whose name contains a
    query, in any case; with ``direct``, or where nothing is found, definitions and calls by pattern from the lines.  Without ``k`` all of them.

    ``docs``: the documents of the ranked search (as ``tables.search_docs`` makes them, ids path:kind:name:line); what is found is then ordered by their score first, before the limit.
    """
    from lodestrata.operators import lines as L

    q, want = query.lower(), KIND_ALIASES.get(kind, kind)
    held = lambda c: F.contains(F.lower(c), F.lit(q))
    name = F.when(F.col("kind") == "constructor", F.concat_ws(".", "parent", "name")).when(F.col("kind") == "annotation", F.concat(F.lit("@"), "name")).otherwise(F.col("name"))
    kinds = [c for c in NAMED_KINDS if want in (None, c)] + (["class"] if want == "widget" else [])
    parts = []
    if mode in ("definitions", "both") and kinds:
        rows = symbols.where(F.col("kind").isin(*kinds))
        rows = rows.where(F.col("type") != "plain") if want == "widget" else rows
        parts.append(rows.where(held(name)).select(name.alias("name"), F.concat("kind", F.lit("_definition")).alias("type"), "path", "line"))
    if mode in ("calls", "both") and want in (None, "function"):
        parts.append(symbols.where((F.col("kind") == "call") & held("name")).select("name", F.lit("function_call").alias("type"), "path", "line"))
    if want in (None, "file"):
        base = F.element_at(F.split("path", "/"), -1)
        parts.append(files.where(held(base)).select(base.alias("name"), F.lit("file").alias("type"), "path", F.lit(None).cast("int").alias("line")))
    found = reduce(DataFrame.unionByName, parts) if parts else None
    if direct or found is None or found.isEmpty():
        rows = L.lines(files)
        defined = L.direct_definitions(rows, query, k, want if want in NAMED_KINDS else None).select("name", F.concat("kind", F.lit("_definition")).alias("type"), "path", "line")
        called = L.direct_calls(rows, query, k).select("name", F.lit("function_call").alias("type"), "path", "line")
        found = {"definitions": defined, "calls": called}.get(mode, defined.unionByName(called))
    elif docs is not None:
        # one score for a name of a kind at a line; calls and files have no document
        place = docs.select("id", "path", "kind", F.element_at(F.split("id", ":"), -1).cast("int").alias("line"))
        scores = scored(docs, query, "ts", overlap=False).join(place, "id").groupBy("path", "kind", "line", F.col("name").alias("bare")).agg(F.max("score").alias("score"))
        found = found.withColumn("bare", F.regexp_replace("name", r"^(.*\.|@)", "")).withColumn("kind", F.regexp_replace("type", "_definition$", ""))
        found = found.join(scores, ["path", "kind", "line", "bare"], "left").drop("bare", "kind")
    score = [F.desc(F.coalesce("score", F.lit(0.0)))] if "score" in found.columns else []
    begins = F.startswith(F.lower("name"), F.lit(q))
    ordered = found.orderBy(*score, F.desc(begins), F.lower("name"), "name", "type", "path", "line").select("name", "type", "path", "line")
    return ordered if k is None else ordered.limit(k)


def rerank(symbols: DataFrame, query: str, k: int = 150) -> DataFrame:
    """Order of the interactive list: exact, prefix, usage count, length, name; without a query usage count and name."""
    q = query.strip().lower()
    name = F.lower("name")
    rows = symbols if not q else symbols.where(F.contains(name, F.lit(q)))
    order = [F.desc("usage_count"), name, F.col("name")]
    if q:
        order = [F.desc(name == q), F.desc(F.startswith(name, F.lit(q))), F.desc("usage_count"), F.char_length("name"), name, F.col("name")]
    return rows.orderBy(*order, "id").limit(k)


def index_signature(files: DataFrame) -> str:
    """A digest of all file hashes in path order, to tell whether an index is up to date.

    Order-free sums of row hashes, so no global sort is needed.
    """
    row = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path", "hash")).alias("x"), F.sum(F.xxhash64("hash", "path").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{row['x'] or 0}-{row['s'] or 0}"
