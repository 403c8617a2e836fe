"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from lodestrata.llm.corpus import table


def op1_license_scan(spark, sf_dir):
    from lodestrata.llm.license_scan import license_spans

    return license_spans(table(spark, sf_dir, "documents"))


def op2_piece_lattice(spark, sf_dir):
    from lodestrata.llm.piece_lattice import sampled_pieces

    return sampled_pieces(table(spark, sf_dir, "documents"))


def op3_pii_bootstrap(spark, sf_dir):
    from lodestrata.llm.pii_bootstrap import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op4_quality_fm(spark, sf_dir):
    from lodestrata.llm.quality_fm import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_parity_jaccard(spark, sf_dir):
    from lodestrata.llm.parity_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op6_template_decontamination(spark, sf_dir):
    from lodestrata.llm.template_decon import contaminated_spans

    return contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_ecoc(spark, sf_dir):
    from lodestrata.llm.lang_ecoc import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    from lodestrata.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op9_byte_shards(spark, sf_dir):
    from lodestrata.llm.byte_shards import byte_shards

    return byte_shards(table(spark, sf_dir, "documents"), 40)


def op10_simhash(spark, sf_dir):
    from lodestrata.llm.simhash_fp import searched_fingerprints

    return searched_fingerprints(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark, sf_dir):
    from lodestrata.llm.token_align import alignment_report

    return alignment_report(table(spark, sf_dir, "documents"))


def op12_pca_negatives(spark, sf_dir):
    from pyspark.sql import functions as F

    from lodestrata.llm.pca_negatives import hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("id") % 50 == 0)


def op13_odd_minhash(spark, sf_dir):
    from lodestrata.llm.odd_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_piece_lattice, op3_pii_bootstrap, op4_quality_fm, op5_parity_jaccard, op6_template_decontamination, op7_language_ecoc, op8_token_counts, op9_byte_shards, op10_simhash, op11_token_alignment, op12_pca_negatives, op13_odd_minhash)}

#: The others have no SQL: compression, fitted models, sampled lattices, tokenizers and their alignment, scored graphs, CRCs and
#: bit votes are beyond it; tests/llm holds those against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op5_parity_jaccard": """WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON e.a = reach.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n""",
    "op12_pca_negatives": """WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id))::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 3""",
    "op13_odd_minhash": """WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON e.a = reach.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n""",
}
