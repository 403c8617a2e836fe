"""Token alignment, hard negatives and odd sketches against brute force on small tables, and on odd rows."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import odd_minhash, pca_negatives, queries, token_align
from lodestrata.llm.corpus import table
from lodestrata.llm.token_count import tokenizer_path


# ---- 11: alignment
def _plain_tokens(text):
    """Ids and bytes of a text's tokens by A and B, by the libraries as they are."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(_plain_tokens, "a"):
        _plain_tokens.a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
        _plain_tokens.a.encode_special_tokens = True
        _plain_tokens.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a, b = _plain_tokens.a, _plain_tokens.b
    if not text:
        return [], []
    kept = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    byte = {chr(c): c for c in kept}
    for c in range(256):
        if c not in kept:
            byte[chr(256 + len(byte) - len(kept))] = c
    left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text, out_type=int):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = b" " + text.encode()
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return [], []
    return left, right


def _plain_groups(left, right):
    groups, i, j, at_a, at_b = [], 0, 0, 0, 0
    while i < len(left):
        a, b = [left[i][0]], [right[j][0]]
        at_a, at_b, i, j = at_a + len(left[i][1]), at_b + len(right[j][1]), i + 1, j + 1
        while at_a != at_b:
            if at_a < at_b:
                a.append(left[i][0])
                at_a, i = at_a + len(left[i][1]), i + 1
            else:
                b.append(right[j][0])
                at_b, j = at_b + len(right[j][1]), j + 1
        groups.append((a, b))
    return groups


def _plain_report(rows):
    texts = [(doc_id, *_plain_tokens(text)) for doc_id, text in rows]
    grouped = [_plain_groups(a, b) for _, a, b in texts]
    held = collections.Counter(p for g in grouped for p in {(x, y) for a, b in g for x in a for y in b})
    top = collections.Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for (doc_id, a, b), g in zip(texts, grouped):
        links = [(x, y) for u, v in g for x in u for y in v]
        spelt = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g)
        out.append((doc_id, len(a), len(b), len(g), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(spelt.encode()).hexdigest() if a else ""))
    return collections.Counter(out)


@pytest.mark.parametrize("common", [1 << 16, 40])
def test_alignment_equals_brute_force(spark, sf, odd, none, monkeypatch, common):
    monkeypatch.setattr(token_align, "COMMON", common)
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rng = random.Random(3)
    strange = ["=-" * 300, "\n" * 90, "<|endoftext|> <s> <0x41>", "naïve 漢字 😀😀", " lead", "trail ", "a\x00b", "▁", *("".join(rng.choice("ab \n'é漢😀12.　=") for _ in range(300)) for _ in range(10))]
    docs = docs.unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(strange)], "doc_id long, text string"))
    got = token_align.alignment_report(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == _plain_report([tuple(r) for r in docs.collect()])
    assert token_align.alignment_report(none).collect() == []


def test_large_groups_count_distinct_ids():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 500), rng.integers(0, 7, 400)
    want = collections.Counter((0, (int(x) << 32) | int(y)) for x in a for y in b)
    got = token_align.pairs(a, b, np.array([500]), np.array([400]), np.zeros(1, np.int64))
    assert {(int(t), int(k)): int(n) for t, k, n in zip(*got)} == want


def test_long_texts_are_cut_where_both_tokenizers_are(monkeypatch):
    t = token_align.tokenizers(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab \n'é漢12.　▁ ") for _ in range(700)) for _ in range(200)] + ["x" * 500, " " * 500]
    whole = t.encoded(texts)
    monkeypatch.setattr(token_align, "PART_CHARS", 10)
    cut = t.encoded(texts)
    assert sum(len(t.parts(x)) > 1 for x in texts) >= 200
    assert all(np.array_equal(x, y) for side, other in zip(whole, cut) for x, y in zip(side, other))


def test_ranks_give_the_ids_of_the_library():
    t = token_align.tokenizers(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    assert t.ranked is not None
    for text in ("don't  stop\r\n\t<|endoftext|>", "é😀漢字 ١٢٣ ", "a" * 3000, " " * 3000):
        assert t._by_a([text])[0].tolist() == t.a.encode(" " + text, add_special_tokens=False).ids


# ---- 12: hard negatives
def _plain_negatives(rows, every, k=5, m=3):
    good = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in (r for r in good if r[0] % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in good if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:k]:
            fits = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:m]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits)]
    return collections.Counter(out)


def _vectors(seed, n, width, ties=False):
    rng = np.random.default_rng(seed)
    axes, centre = rng.normal(size=(width, width)) * np.geomspace(1, 0.05, width)[:, None], rng.normal(size=(4, width))
    rows = []
    for i in range(n):
        y = int(rng.integers(4))
        v = (centre[y] * 0.2 + rng.normal(size=width) @ axes * 0.2 + 0.1).astype(np.float32).tolist()
        rows.append((i, y, [round(x) / 4 for x in v] if ties else v))
    return rows


@pytest.mark.parametrize("ties", [False, True])
def test_negatives_equal_brute_force(spark, monkeypatch, ties):
    monkeypatch.setattr(pca_negatives, "ROW_BLOCK", 64)
    monkeypatch.setattr(pca_negatives, "ANCHOR_BLOCK", 8)
    monkeypatch.setattr(pca_negatives, "HELD", 2)
    rows = _vectors(4, 700, 24, ties)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = pca_negatives.hard_negatives(df, F.col("id") % 10 == 0)
    assert collections.Counter(map(tuple, got.collect())) == _plain_negatives(rows, 10)


def test_anchors_meet_rows_by_a_shuffle(spark):
    """Written blocks look small enough for a broadcast, which would hold the anchors once for each bin in the driver."""
    rows = spark.createDataFrame([(k, k % 3, [float(k), 1.0]) for k in range(100)], "id long, label long, vector array<double>")
    blocks = pca_negatives.written(pca_negatives._packed(rows, 2, 1.0), "vectors")
    for same in (True, False):
        met = pca_negatives._met(blocks, blocks, 4, same)
        assert met.count() == blocks.count() ** 2
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_negatives_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [0.5, 0.5]), (10, 1, [0.5, 0.4]), (10, 1, [0.5, 0.4]), (3, 2, [0.3, 0.3]), (4, 2, [0.3, 0.3]), (5, 2, [0.4, 0.2]), (6, 2, [0.3]), (7, None, [0.3, 0.3]), (8, 2, None), (9, 2, [0.3, None]), (11, 2, [nan, 0.3]), (12, 2, [inf, 0.3]), (None, 2, [0.3, 0.3]), (20, 9, [-0.5, -0.5]), (13, 2, [])]
    kind = "vec_id long, label int, embedding array<float>"
    df = spark.createDataFrame(rows, kind).withColumns({c: F.lit("x") for c in ("id", "vector", "block", "score", "bin")})
    got = collections.Counter(map(tuple, pca_negatives.hard_negatives(df, F.col("id") % 10 == 0).collect()))
    # a repeated anchor answers for each of its rows
    want = _plain_negatives(rows, 10)
    assert got == want and any(n > 1 for n in want.values())
    text = df.withColumn("label", F.concat(F.lit("l"), F.col("label")))
    assert collections.Counter(map(tuple, pca_negatives.hard_negatives(text, F.col("id") % 10 == 0).collect())) == want
    assert pca_negatives.hard_negatives(spark.createDataFrame([], kind), F.col("id") % 10 == 0).collect() == []
    assert pca_negatives.hard_negatives(df, F.col("id") == -1).collect() == []


def test_bounds_hold_and_discard():
    rng = np.random.default_rng(2)
    q = np.floor(rng.normal(size=(400, 32)) * np.geomspace(300, 3, 32)).astype(np.int32) @ np.linalg.qr(rng.normal(size=(32, 32)))[0]
    q = np.floor(q).astype(np.int32)
    axes, ends = pca_negatives.rotation((q.T.astype(float) @ q)), pca_negatives.stage_ends(32)
    ids = np.arange(400)
    side = pca_negatives.Side(ids, ids % 2, q, axes, ends)
    exact = q.astype(np.int64) @ q.T.astype(np.int64)
    seen = []

    def wanted(low, high):
        seen.append(((low <= exact) & (exact <= high)).all())
        bar = pca_negatives.kth_largest(low, 5)
        return high >= bar[:, None], bar, np.full(400, np.inf)

    i, j, score = pca_negatives.scored(side, side, ends, pca_negatives.slack(axes), wanted)
    assert all(seen) and len(i) < 0.2 * exact.size and np.array_equal(score, exact[i, j])
    fifth = np.sort(exact, axis=1)[:, -5]
    assert {(a, b) for a, b in zip(*np.nonzero(exact >= fifth[:, None]))} <= set(zip(i.tolist(), j.tolist()))


def test_components_too_large_for_whole_numbers(spark):
    df = spark.createDataFrame([(0, 1, [1e300, 1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        pca_negatives.hard_negatives(df, F.col("id") == 0).collect()


# ---- 13: odd sketches
def _set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) if len(words) >= 4 else frozenset([tuple(words)])


def _plain_duplicates(rows):
    ids, sets = [r[0] for r in rows], [_set(r[1]) for r in rows]
    holders, root = collections.defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, s in enumerate(sets):
        for t in s:
            holders[t].append(k)
    met = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in met:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return collections.Counter((i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, i in enumerate(ids))


def _near_texts(seed, groups, words, spread):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(words)}" for _ in range(rng.choice([1, 3, 4, 6, 12, 40, 150, 400]))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // spread))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10 ** 6)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize(("most", "seed"), [(1 << 14, 1), (1, 2), (1, 3)])
def test_odd_sketch_classes_equal_brute_force(spark, monkeypatch, odd, most, seed):
    monkeypatch.setattr(odd_minhash, "PAIRS", most)
    rows = list(enumerate(_near_texts(seed, 150, 4000, 45)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = odd_minhash.near_duplicates(docs)
    want = _plain_duplicates([tuple(r) for r in docs.collect()])
    assert collections.Counter(map(tuple, got.collect())) == want
    assert sum(n for (_, _, _, kept), n in want.items() if not kept) > 100


def test_a_template_in_every_document(spark, monkeypatch):
    """Most of each document is the same passage, so every band's buckets are large; few of them link."""
    monkeypatch.setattr(odd_minhash, "PAIRS", 4)
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(k, f"{passage} " + " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(rng.choice([2, 12, 30])))) for k in range(150)]
    rows += [(200 + k, t + " tail") for k, t in rows[::3]]
    got = odd_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter(map(tuple, got.collect())) == _plain_duplicates(rows)


def test_odd_rows(odd, none):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in odd_minhash.near_duplicates(odd.withColumns({c: F.lit("x") for c in ("node", "bands", "sid", "k0", "_rep")})).collect()}
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[6, 2] == (5, False) and got[None, 1] == (None, True)
    assert odd_minhash.near_duplicates(none).collect() == []


def test_odd_sketches_estimate_and_keep_links():
    """At a similarity of 0.8 the count stays far below the cut and bands agree often, for small and large sets."""
    rng = np.random.default_rng(7)
    for size in (5, 50, 900):
        same, extra = rng.integers(0, 2**63, size * 8 // 10 or 4, dtype=np.int64).view(np.uint64), []
        most, fewest, guesses = 0, 64, []
        for _ in range(200):
            same = rng.integers(0, 2**63, max(4, size * 8 // 10), dtype=np.int64).view(np.uint64)
            extra = rng.integers(0, 2**63, max(1, size * 2 // 10), dtype=np.int64).view(np.uint64)
            half = len(extra) // 2
            a, b = np.concatenate([same, extra[:half]]), np.concatenate([same, extra[half:]])
            s = odd_minhash.samples_of([np.sort(a), np.sort(b)])
            odd = odd_minhash.odd_sketches(s)
            count = sum(int(x).bit_count() for x in (odd[0] ^ odd[1]).view(np.uint64).tolist())
            bands = odd_minhash.bands_of(s)
            most, fewest = max(most, count), min(fewest, int((bands[0] == bands[1]).sum()))
            guesses.append(float(odd_minhash.estimate(count)))
        assert most <= 125 and fewest >= 10
        assert abs(np.mean(guesses) - len(same) / (len(same) + len(extra))) < 0.02
    assert odd_minhash.estimate(0) == 1.0


@pytest.mark.parametrize("name", ["op12_pca_negatives", "op13_odd_minhash"])
def test_new_queries_equal_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(tuple(r[k] for k in at) for r in want.fetchall())
