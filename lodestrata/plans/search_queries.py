"""Ranked and line search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.tokens import ascii_tokens
from lodestrata.operators import lines as L
from lodestrata.operators import search as S
from lodestrata.plans.adapters import FILES, LINES, files, lines_sql, part_docs, query, table


def _tok(c: str) -> str:
    split = f"regexp_replace(regexp_replace(coalesce({c}, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(lower(regexp_replace({split}, '[^a-zA-Z0-9]', ' ', 'g')), ' +'), lambda x: length(x) > 1)"


def _rs_tok(c: str) -> str:
    """For ASCII texts without capitals, underscores or digits inside words the rs tokens are the words."""
    return f"list_filter(string_split_regex(lower(regexp_replace(coalesce({c}, ''), '[^a-zA-Z0-9]', ' ', 'g')), ' +'), lambda x: x <> '')"


def _bm25_sql(source: str, fields: dict, terms: list, query_text: str, boosts: tuple, least: int, k: int, tok=_tok, eps: float = 0.0, places: int = 4, contains_too: bool = False) -> str:
    n = len(terms)
    tf = lambda t: " + ".join(f"{w} * len(list_filter(t_{f}, lambda x: x = '{t}'))" for f, w in fields.items())
    tokens = ", ".join(f"{tok(f)} AS t_{f}" for f in fields)
    parts = " + ".join(f"CASE WHEN tf{i} > 0 THEN greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1), 0.1) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * dl / (avgdl + {eps}))) ELSE 0 END" for i in range(n))
    hits = " + ".join(f"(tf{i} > 0)::INT" for i in range(n))
    q = query_text.lower()
    return f"""WITH tok AS (SELECT id, name, {tokens} FROM {source}),
    f AS (SELECT id, name, {' + '.join(f'{w} * len(t_{x})' for x, w in fields.items())} AS dl, {', '.join(f'{tf(t)} AS tf{i}' for i, t in enumerate(terms))} FROM tok),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(n))} FROM f),
    r AS (SELECT id, name, {parts} + CASE WHEN lower(name) = '{q}' THEN {boosts[0]} WHEN starts_with(lower(name), '{q}') THEN {boosts[1]} WHEN contains(lower(name), '{q}') THEN {boosts[2]} ELSE 0 END AS score
      FROM f, s WHERE {hits} >= {least} {f"OR contains(lower(name), '{q}')" if contains_too else ''})
    SELECT id, name, round(score, {places}) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, id LIMIT {k}"""


_DOCS = "(SELECT doc_id AS id, source AS name, text AS comments FROM documents)"
_PARTS = "(SELECT p_partkey AS id, p_name AS name, p_type AS path, p_brand AS superclass FROM part)"
_PART_FIELDS = {"name": 4.0, "path": 1.5, "superclass": 2.0}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("comments"))


def _top(df):
    return df.select("id", "name", F.round("score", 4).alias("score"))


@query(_bm25_sql(_DOCS, {"name": 4.0, "comments": 0.3}, ["erly", "oued"], "erly oued", (10, 5, 2), 1, 50))
def bm25_topk_ts(spark, sf_dir):
    return _top(S.search(_docs(spark, sf_dir), "erly oued", "ts", 50))


@query(_bm25_sql(_DOCS, {"name": 4.0, "comments": 0.3}, ["erly", "oued"], "erly oued", (10, 5, 2), 1, 50))
def bm25_incremental_index(spark, sf_dir):
    """The index of two thirds of the documents, of which some are then dropped, brought up to date."""
    d = _docs(spark, sf_dir)
    old = S.unindexed(S.indexed(d.where("id % 3 != 0")), d.where("id % 3 = 1"))
    return _top(S.search_index(S.reindexed(old, d.where("id % 3 != 2")), "erly oued", "ts", 50))


@query(_bm25_sql(_PARTS, _PART_FIELDS, ["blue", "bolt"], "blue bolt", (10, 4, 1.5), 1, 50, tok=_rs_tok, eps=1e-9, places=3, contains_too=True))
def bm25_index_rs(spark, sf_dir):
    return S.search_index(S.indexed(part_docs(spark, sf_dir), "rs"), "blue bolt", "rs", 50)


@query(_bm25_sql(_DOCS, {"name": 4.0, "comments": 0.3}, ["thing", "enst", "heble"], "thing enst heble", (10, 5, 2), 2, 50))
def bm25_overlap2(spark, sf_dir):
    return _top(S.search(_docs(spark, sf_dir), "thing enst heble", "ts", 50))


@query(_bm25_sql(_PARTS, _PART_FIELDS, ["red", "widget"], "red widget", (10, 5, 2), 1, 500))
def bm25_name_boost(spark, sf_dir):
    return _top(S.search(part_docs(spark, sf_dir), "red widget", "ts", 500))


@query(_bm25_sql(_PARTS, _PART_FIELDS, ["blue", "bolt"], "blue bolt", (10, 4, 1.5), 1, 50, tok=_rs_tok, eps=1e-9, places=3, contains_too=True))
def bm25_topk_rs(spark, sf_dir):
    return S.search(part_docs(spark, sf_dir), "blue bolt", "rs", 50)


@query(f"""WITH t AS (SELECT DISTINCT id, unnest({_tok('comments')}) AS term FROM {_DOCS}), n AS (SELECT count(*) AS n FROM documents)
    SELECT term, count(*) AS df, round(greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 0.1), 6) AS idf FROM t, n GROUP BY term""")
def idf_table(spark, sf_dir):
    return S.idf_table(_docs(spark, sf_dir).drop("name"), "ts").withColumn("idf", F.round("idf", 6))


@query(f"SELECT id, CAST(round(4.0 * len({_tok('name')}) + 0.3 * len({_tok('comments')}), 4) AS DOUBLE) AS dl FROM {_DOCS}")
def doc_lengths(spark, sf_dir):
    return S.doc_lengths(_docs(spark, sf_dir), "ts").withColumn("dl", F.round("dl", 4))


@query(f"""WITH t AS (SELECT id, unnest({_tok('name')}) AS term, 4.0 AS w FROM {_PARTS} UNION ALL SELECT id, unnest({_tok('path')}), 1.5 FROM {_PARTS} UNION ALL SELECT id, unnest({_tok('superclass')}), 2.0 FROM {_PARTS})
    SELECT id, term, CAST(sum(w) AS DOUBLE) AS tf FROM t GROUP BY id, term""")
def field_weights(spark, sf_dir):
    return S.weighted_terms(part_docs(spark, sf_dir), "ts")


def _symbols(spark, sf_dir):
    p, c, s = (table(spark, sf_dir, t) for t in ("part", "customer", "supplier"))
    parts = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("usage_count"))
    customers = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("usage_count"))
    suppliers = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("usage_count"))
    return parts.unionByName(customers).unionByName(suppliers)


_SYMBOLS = """(SELECT 'p' || p_partkey AS id, 'part' AS kind, p_name AS name, CAST(p_size AS BIGINT) AS usage_count FROM part UNION ALL
    SELECT 'c' || c_custkey, 'customer', c_name, c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, s_nationkey FROM supplier)"""


@query(f"SELECT kind, id, name FROM {_SYMBOLS} WHERE contains(lower(name), 'er#0000001')")
def search_kinds_union(spark, sf_dir):
    return S.rerank(_symbols(spark, sf_dir), "er#0000001", 2**31 - 1).select("kind", "id", "name")


@query(f"""SELECT id, kind, name, usage_count FROM {_SYMBOLS} WHERE contains(lower(name), 'red')
    ORDER BY (lower(name) = 'red') DESC, starts_with(lower(name), 'red') DESC, usage_count DESC, length(name), lower(name), name, id LIMIT 150""")
def rerank_ui(spark, sf_dir):
    return S.rerank(_symbols(spark, sf_dir), "red").select("id", "kind", "name", "usage_count")


@query(_bm25_sql(_PARTS, _PART_FIELDS, ["ring"], "ring", (10, 5, 2), 1, 1_000_000, places=12).replace("WITH tok", "WITH scores AS (WITH tok", 1).replace("ORDER BY r.score DESC, id LIMIT 1000000", ")\n    SELECT p_partkey AS id, p_name AS name, round(coalesce(score, 0), 4) AS score FROM part LEFT JOIN scores ON scores.id = p_partkey WHERE contains(lower(p_name), 'ring') ORDER BY coalesce(scores.score, 0) DESC, starts_with(lower(p_name), 'ring') DESC, lower(p_name), p_name, p_partkey LIMIT 500"))
def symbol_substring_search(spark, sf_dir):
    return _top(S.symbol_search(part_docs(spark, sf_dir), "ring", 500))


@query(f"SELECT path, line, text FROM {LINES} WHERE contains(lower(text), 'thest') ORDER BY path, line LIMIT 100")
def text_search_lines(spark, sf_dir):
    return L.search_text(L.lines(files(spark, sf_dir)), "thest", k=100).select("path", "line", "text")


@query(f"SELECT path, line, CAST(len(regexp_extract_all(text, '[Tt]h[aeiou]{{2}}n')) AS INTEGER) AS n FROM {LINES} WHERE regexp_matches(text, '[Tt]h[aeiou]{{2}}n')")
def regex_matches(spark, sf_dir):
    found = L.search_text(L.lines(files(spark, sf_dir)), "[Tt]h[aeiou]{2}n", regex=True, case_sensitive=True, k=2**31 - 1, per_match=True)
    return found.groupBy("path", "line").agg(F.count("*").cast("int").alias("n"))


@query(f"SELECT path, line, CAST(len(regexp_extract_all(text, '\\bering\\b')) AS INTEGER) AS hits FROM {lines_sql('(SELECT conv_id || chr(47) || turn AS path, text AS content FROM conversations)')} WHERE regexp_matches(text, '\\bering\\b')")
def word_references(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.col("text").alias("content"))
    return L.word_references(L.lines(c), "ering").select("path", "line", "hits")


@query(f"SELECT path, line, text FROM {LINES} WHERE path = (SELECT min(path) FROM {FILES} WHERE content LIKE '%' || chr(10) || '%' || chr(10) || '%') AND line BETWEEN 2 AND 101")
def read_lines(spark, sf_dir):
    f = files(spark, sf_dir)
    path = f.where(F.col("content").like("%\n%\n%")).agg(F.min("path")).first()[0]
    return L.read_lines(f, path, 2).select("path", "line", "text")


_PAGE_LINES = lines_sql("(SELECT url AS path, page_id, html AS content FROM pages)")


@query(f"SELECT path, line FROM {_PAGE_LINES} WHERE contains(lower(text), '<title>the') ORDER BY path, line LIMIT 50")
def package_search_limited(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))
    return L.search_text(L.lines(p), "<title>The", k=50).select("path", "line")


@query(f"SELECT doc_id, CAST(len({_tok('text')}) AS INTEGER) AS n FROM documents")
def token_counts_ascii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ascii_tokens("text")).alias("n"))
