"""Each operator against brute force on small tables, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import byte_shards, kernels as K, lang_ecoc, license_scan, parity_join, pii_bootstrap, piece_lattice, quality_fm, queries, simhash_fp, template_decon, token_count
from lodestrata.llm.corpus import table


# ---- 1: license scans
def test_license_wordings(spark, odd, none):
    notice = license_scan.TEMPLATES["Apache-2.0/notice"]
    header = license_scan.TEMPLATES["Apache-2.0/header"]
    texts = [f"prose\n{notice}", header, "This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY 4.0.", "a permission of mine", f"x {notice} y", notice.replace("Licensed", "Released")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_spans(df).collect()}
    assert (got[0]["license"], got[0]["exact"], got[0]["start"], got[0]["end"]) == ("Apache-2.0", True, 6, 6 + len(notice) - 1)
    assert got[1]["template"] == "Apache-2.0/header" and got[1]["exact"]
    assert got[2]["license"] == "GPL-2.0" and got[3]["license"] == "CC-BY-4.0"
    assert 4 not in got and got[5]["license"] == "Apache-2.0" and got[5]["exact"]
    assert got[6]["license"] == "Apache-2.0" and got[6]["lacks"] == "licensed"
    assert license_scan.license_spans(odd).count() == 0 and license_scan.license_spans(none).count() == 0


def test_license_scan_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    got = collections.Counter((r["doc_id"], r["license"]) for r in license_scan.license_spans(docs).collect())
    known = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    want = collections.Counter((r["doc_id"], k) for r in docs.collect() for k, t in known.items() for _ in range((r["text"] or "").count(t)))
    assert got == want


def test_every_license_of_a_block():
    apache, mit, header = (license_scan.TEMPLATES[k] for k in ("Apache-2.0/notice", "MIT/notice", "Apache-2.0/header"))
    names = lambda text: [(r["template"], text[r["start"] : r["end"]]) for r in license_scan.scan_text(text)]
    a, m = ("Apache-2.0/notice", apache[:-1]), ("MIT/notice", mit[:-1])
    assert names(f"{apache} {mit}") == [a, m] and names(f"{mit} or {mit} or {apache}") == [m, m, a]
    wrapped = re.sub(r"((?:\S+ ){9}\S+) ", "\\1\n", f"{header} {header}")
    assert [t for t, _ in names(wrapped)] == ["Apache-2.0/header"] * 2
    assert [t for t, _ in names(header.replace("specific", "exact"))] == ["Apache-2.0/header"]


def test_wordings_that_licenses_share():
    t = license_scan.TEMPLATES
    names = lambda text: [(r["license"], r["exact"]) for r in license_scan.scan_text(text)]
    assert names(t["BSD-2-Clause/text"]) == [("BSD-2-Clause", True)] and names(t["BSD-3-Clause/text"]) == [("BSD-3-Clause", True)]
    assert names(t["BSD/opening"]) == [("BSD", True)] and names(t["BSD-3-Clause/condition"]) == [("BSD-3-Clause", True)]
    for version in "23":
        for rest in ("or-later", "only"):
            assert names(t[f"GPL-{version}.0-{rest}/header"]) == [(f"GPL-{version}.0-{rest}", True)]
    assert names(t["0BSD/text"]) == [("0BSD", True)] and names(t["ISC/text"]) == [("ISC", True)] and names(t["EPL-2.0/notice"]) == [("EPL-2.0", True)]


def test_every_notice_at_every_place():
    """Planted notices, verbatim, in lines and paragraphs of any length: all are found where they stand, and nothing else."""
    rng = random.Random(11)
    for _ in range(60):
        text, want = "", []
        for _ in range(rng.randint(1, 6)):
            text += " ".join("".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(rng.choice([0, 1, 3, 40, 700]))) + rng.choice([" ", "\n", "\n\n"])
            name, notice = rng.choice(list(license_scan.TEMPLATES.items()))
            want.append((len(text), name.split("/")[0]))
            text += notice + rng.choice([". ", "\n", "\n\n"])
        got = [(r["start"], r["license"]) for r in license_scan.scan_text(text) if r["exact"]]
        starts = [(at + (len(x) - len(x.lstrip('"'))), name) for (at, name), x in zip(want, (text[at:] for at, _ in want))]
        assert got == starts


def test_short_notices_in_long_lines():
    rng = random.Random(4)
    common = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so".split()
    prose = " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("aeioulnrst", k=6)) for _ in range(4000))
    for name in ("MIT/notice", "CC-BY-4.0/notice", "GPL-3.0/notice", "Apache-2.0/notice"):
        notice = license_scan.TEMPLATES[name]
        text = f"{prose} {notice} {prose} {notice}"
        got = [(r["template"], r["start"], r["exact"]) for r in license_scan.scan_text(text)]
        assert got == [(name, len(prose) + 1, True), (name, len(text) - len(notice), True)]
    assert license_scan.scan_text(f"{prose} license {prose}") == []


# ---- 2: sampled pieces
def test_pieces_round_trip_and_repeat(spark, sf, odd, none):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = piece_lattice.sampled_pieces(docs).cache()
    assert rows.where("not lossless").count() == 0
    back = piece_lattice.decoded(rows)
    a = collections.Counter(map(tuple, docs.collect()))
    assert a == collections.Counter(map(tuple, back.collect()))
    other = piece_lattice.sampled_pieces(docs.repartition(7, "text"))
    key = lambda df: sorted((str(r["doc_id"]), r["text_sha256"], tuple(r["pieces"] or ())) for r in df.collect())
    assert key(rows) == key(other)
    assert piece_lattice.sampled_pieces(none).count() == 0


def test_pieces_follow_the_lattice():
    vocab = piece_lattice.vocabulary(token_count.tokenizer_path())
    weight = {vocab.pieces[i]: w for _, ids, ws in vocab.tables.values() for i, w in zip(ids, ws)}

    def segmentations(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in weight:
                yield from ((s[:n], *rest) for rest in segmentations(s[n:]))

    total = {}
    for s in segmentations("▁there"):
        p = 1.0
        for piece in s:
            p *= weight[piece]
        total[s] = p
    n, z = 60_000, sum(total.values())
    offs, ids = piece_lattice.encode_batch(vocab, piece_lattice.np.arange(n), ["there"] * n)
    seen = collections.Counter(tuple(vocab.pieces[i] for i in ids[a:b]) for a, b in zip(offs[:-1], offs[1:]))
    assert set(seen) <= set(total) and max(abs(seen[s] / n - total[s] / z) for s in total) < 0.01


def test_long_units():
    vocab = piece_lattice.vocabulary(token_count.tokenizer_path())
    texts = ["a" * 5000, "漢" * 300 + "xyz", "the" * 700 + " end"]
    offs, ids = piece_lattice.encode_batch(vocab, piece_lattice.np.arange(3), texts)
    assert [piece_lattice.decode(vocab, ids[a:b].tolist()) for a, b in zip(offs[:-1], offs[1:])] == texts


# ---- 3: personal data
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "phone": 9 <= len(digits) <= 15}[kind]


def _plain_base(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if _valid(kind, m[0])]
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found))


def test_base_spans_equal_brute_force(spark, sf, odd, none):
    rng = random.Random(3)
    alphabet = ["a", "b.c", "@", "1", "22", "255", "256", ".", " ", "-", "+", "(", ")", "é", "😀", "4539148803436467", "x@y.z", "+1 (437) 555-0689", "%", "\n", "0"]
    made = [(1000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(600)] + [(9000, "9" * 30000), (9001, "a" * 30000 + "@"), (9002, "a@b.c%d@e.f"), (9003, "1.2.3.4.5.6.7.8")]
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(made, "doc_id long, text string")).cache()
    got = sorted((str(r["doc_id"]), r["base_sha256"]) for r in pii_bootstrap.personal_data(docs).collect())
    want = sorted((str(r["doc_id"]), hashlib.sha256(_plain_base(r["text"]).encode()).hexdigest()) for r in docs.collect())
    assert got == want
    assert pii_bootstrap.personal_data(none).count() == 0


def test_patterns_find_unseen_identifiers(spark):
    seeds = [(i, f"some words, server address {10 + i}.20.30.{i} was used") for i in range(6)]
    rows = [*seeds, (50, "today the server address AB12-99X7 was used"), (51, "server address is not AB12-99X7"), (52, "other token 12345-AB here")]
    key = "ab" * 20
    rows += [(100 + i, f'word token = "{i:02d}{key[2:]}" word') for i in range(4)]
    out = {r["doc_id"]: r for r in pii_bootstrap.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100]["spans"].startswith("secret:") and out[100]["n_found"] == 1
    assert out[51]["n_found"] == 0 and out[52]["n_found"] == 0
    assert all(out[i]["n_ip"] == 1 for i in range(6))


def test_patterns_back_off_to_fewer_words(spark):
    rows = [(i, f"some words, server address {10 + i}.20.30.{i} was used") for i in range(6)]
    rows += [(50, "today the server address AB12-99X7 was used"), (51, "server address is not AB12-99X7"), (52, "address AB12-99X8")]
    out = {r["doc_id"]: r for r in pii_bootstrap.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[50]["spans"] == "ctx_ip:25:34" and out[50]["n_found"] == 1
    assert out[51]["n_found"] == 0 and out[52]["spans"] == "ctx_ip:8:17"


def test_whole_base_entities_seed_patterns(spark):
    cards = ["4111 1111 1111 1111", "5555 5555 5555 4444", "4012 8888 8888 1881", "3530 1113 3330 0000"]
    rows = [(i, f"please write to {name}.doe@example.com now") for i, name in enumerate(["jane", "john", "mary", "ann"])]
    rows += [(10 + i, f"my bank card {c} is here") for i, c in enumerate(cards)]
    rows += [(20 + i, f"you may call me at +1 (48{i}) 555-720{i} today") for i in range(4)]
    unseen = {30: ("please write to ", "jane.doe@localhost", "ctx_email"), 31: ("this is my bank card ", "4111 1111 1111 1112", "ctx_card"), 32: ("or call me at ", "(020) 7946 0958", "ctx_phone")}
    rows += [(i, f"{before}{v} now") for i, (before, v, _) in unseen.items()]
    rows += [(40, "we met jane.doe@localhost and 4111 1111 1111 1112 and (020) 7946 0958 there")]
    out = {r["doc_id"]: r for r in pii_bootstrap.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (before, v, kind) in unseen.items():
        assert out[i]["spans"] == f"{kind}:{len(before)}:{len(before) + len(v)}"
    assert out[40]["n_found"] == 0 and out[10]["n_card"] == 1 and out[20]["spans"] == "phone:19:36"


def test_common_words_tell_nothing(spark):
    """Entities behind a word that stands before everything make no identifiers of other numbers behind it; a telling word does."""
    cards = ["4111111111111111", "5555555555554444", "4012888888881881", "3530111333300000"]
    rows = [(i, f"the {c} was noted and the man saw the house near the old mill of the town") for i, c in enumerate(cards)]
    rows += [(10 + i, "the cat and the dog ran over the hill to the sea and the sun set") for i in range(20)]
    rows += [(20 + i, f"pay by visacard {c} please") for i, c in enumerate(cards)]
    rows += [(40, "the 4111111111111112 was a number"), (41, "pay by visacard 4111111111111113 please"), (42, "visacard 1234567890123456 once more")]
    out = {r["doc_id"]: r["spans"] for r in pii_bootstrap.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[40] == "" and out[0] == "card:4:20"
    assert out[41] == "ctx_card:16:32" and out[42] == "ctx_card:9:25"


def test_occurrences_of_contexts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "a", "of", "Card", "at", "|"]) for _ in range(rng.randrange(30))).replace(" of", "\n of") for _ in range(40)] + [None, ""]
    contexts = ["the ", "of the ", "card at the ", "| ", "never "]
    got = {r["context"]: r["places"] for r in pii_bootstrap.occurrences(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(c,) for c in contexts], "context string")).collect()}
    want = collections.Counter(c for t in texts for w in [re.sub(r"\s+", " ", (t or "").lower()).split(" ")] for i in range(len(w)) for c in contexts if (n := c.split()) == w[max(0, i - len(n) + 1) : i + 1])
    assert got == want


def test_redaction_keeps_columns(spark, odd, none):
    out = pii_bootstrap.redacted(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r["doc_id"]: r for r in out.collect()}
    assert texts[5]["text"] == "Hello world, mail [EMAIL] now" and texts[5]["n_chars"] == len(texts[5]["text"]) and texts[5]["digest"] == 1
    assert texts[1]["text"] is None and pii_bootstrap.redacted(none).count() == 0


def test_dense_texts(spark):
    """Tens of thousands of matches in one text, in time that grows with them."""
    rng = random.Random(12)
    part = lambda i: rng.choice([f"user{i}@mail.example", f"10.{i % 256}.0.{i % 99}", "4111 1111 1111 1111", f"+1 (487) 555-{i % 10000:04d}", f"AB-{i:07d}", "plain é words"])
    rows = [(1, " ; ".join(part(i) for i in range(40_000))), (2, "a@b.c," * 3000), (3, "x" * 2047 + " a@b.c " + "é" * 4096 + " 10.0.0.1"), (4, "short a@b.c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    out = {r["doc_id"]: r for r in pii_bootstrap.personal_data(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii_bootstrap.redacted(docs).collect()}
    assert time.time() - began < 120
    for i, text in rows:
        base = _plain_base(text)
        assert out[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        at, want = 0, []
        for kind, s, e in sorted((x.split(":") for x in out[i]["spans"].split(",")), key=lambda x: int(x[1])):
            if int(s) >= at:
                want += [text[at : int(s)], f"[{kind.upper()}]"]
            at = max(at, int(e))
        assert clean[i] == "".join(want) + text[at:]


def test_running_totals(spark, monkeypatch):
    monkeypatch.setattr(pii_bootstrap, "CHUNK", 3)
    rng = random.Random(13)
    rows = [(k, [(s := rng.randrange(40), s + rng.randrange(1, 9)) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 3, 4, 7, 30])]
    df = spark.createDataFrame(rows, "k long, spans array<struct<s:int,e:int>>")
    got = {r["k"]: r for r in df.select("k", pii_bootstrap.running(F.col("spans"), lambda x: x["e"], lambda a, b: F.greatest(a, b), F.lit(0)).alias("r"), pii_bootstrap.outer(F.col("spans")).alias("o")).collect()}
    for k, spans in rows:
        assert [m["at"] for m in got[k]["r"]] == [max([0, *(e for _, e in spans[:i])]) for i in range(len(spans))]
        keep = [(s, e) for s, e in spans if not any(a <= s and b >= e and b - a > e - s for a, b in spans)]
        assert [tuple(x) for x in got[k]["o"]] == sorted(keep, key=lambda x: (x[0], -x[1]))


# ---- 4: quality
def test_quality_is_learnt(spark, sf, odd, none):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = quality_fm.quality_scores(docs, labels).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.97 * got.count()
    assert quality_fm.quality_scores(odd, labels).count() == odd.count() and quality_fm.quality_scores(none, labels).count() == 0
    unlabelled = quality_fm.quality_scores(odd, labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {1.0}
    kept = quality_fm.keep_good(odd, labels)
    assert kept.columns == odd.columns


def test_repeated_rows_teach_once(spark, sf):
    docs, labels = (table(spark, sf, t) for t in ("documents", "labels"))
    few = docs.where("doc_id < 120")
    again = few.unionByName(few).unionByName(few.where("doc_id % 3 = 0").selectExpr("doc_id", *[c for c in few.columns if c not in ("doc_id", "text")], "concat('~', text) AS text"))
    same = lambda df, cols: sorted({tuple(r[c] for c in cols) for r in df.join(few.select("doc_id", "text"), ["doc_id"]).collect()}, key=str)
    kept = quality_fm.keep_good(few.unionByName(few), labels).groupBy("doc_id").count().collect()
    assert {r["count"] for r in kept} == {2} and {r["doc_id"] for r in kept} == {r["doc_id"] for r in quality_fm.keep_good(few, labels).collect()}
    for f, cols in ((lambda d: quality_fm.quality_scores(d, labels), ("doc_id", "score")), (lang_ecoc.predict_languages, ("doc_id", "lang_pred", "score"))):
        assert same(f(few.unionByName(few)), cols) == same(f(few), cols)
    assert lang_ecoc.predict_languages(again).count() == again.count()


def test_factorisation_identity():
    np = quality_fm.np
    rng = np.random.default_rng(0)
    model = {"w": rng.normal(size=quality_fm.N_FEATURES), "v": rng.normal(size=(quality_fm.N_FEATURES, 4)), "bias": 0.3}
    index, value = np.array([3, 9, 4000, 8200, 5, 7]), rng.normal(size=6)
    got = quality_fm.margins(model, np.array([0, 4, 6]), index, value)
    for d, (a, b) in enumerate([(0, 4), (4, 6)]):
        pairs = sum(model["v"][index[i]] @ model["v"][index[j]] * value[i] * value[j] for i in range(a, b) for j in range(i + 1, b))
        assert got[d] == pytest.approx(0.3 + (model["w"][index[a:b]] * value[a:b]).sum() + pairs)


def _plain_hash(word: bytes) -> int:
    """The hash of a word, one byte after the other."""
    h, up = 0, 1
    for b in word:
        h, up = (h + int(K.BYTE_VALUE[b]) * up) % 2**64, up * K._BASE % 2**64
    return _plain_mix((h + len(word) * K._STEP) % 2**64)


def _plain_mix(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def _plain_words(text: str) -> list[bytes]:
    return re.findall(rb"[^ \t-\r]+", text.encode())


def _plain_features(text: str) -> dict:
    """Feature number -> value, by loops over words and characters."""
    data, words, out = text.encode(), _plain_words(text), collections.Counter()
    cells = collections.Counter(_plain_hash(w) >> 64 - quality_fm.WORD_BITS for w in words)
    norm = max(1, sum(n * n for n in cells.values())) ** 0.5
    for c, n in cells.items():
        out[c] = n / norm
    kind = collections.Counter(int(quality_fm._CLASS[b]) for b in data)
    low = [w.lower() for w in words]
    unit = lambda x, top: min(1, math.log1p(x) / math.log1p(top))
    of, many = max(1, len(data)), max(1, len(words))
    stats = [kind[k] / of for k in range(1, 9)] + [unit(len(data), 1e6), unit(len(words), 1e5), min(1, len(data) / many / 20)]
    stats += [sum(a == b for a, b in zip(low, low[1:])) / many, len(cells) / many, unit(data.count(b"\n"), 1e4)]
    stats += [sum(quality_fm._CLASS[w[-1]] >= 7 for w in words) / many, sum(quality_fm._CLASS[w[min(1, len(w) - 1)]] == 1 for w in words) / many]
    for k, x in enumerate(stats):
        place = min(1, max(0, x)) ** 0.5 * (quality_fm.KNOTS - 1)
        at = min(int(place), quality_fm.KNOTS - 2)
        for j, share in ((at, 1 - (place - at)), (at + 1, place - at)):
            out[quality_fm.N_WORDS + k * quality_fm.KNOTS + j] += share
    return out


def test_scores_equal_brute_force(spark, sf):
    """The registered query against a model evaluated pair by pair."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_fm.fit(docs, labels)
    got = {r["doc_id"]: r for r in queries.op4_quality_fm(spark, sf).collect()}
    assert len(got) == docs.count()
    for doc, text in docs.select("doc_id", "text").collect():
        x = [(i, v) for i, v in _plain_features(text or "").items() if v]
        at = [i for i, _ in x]
        scaled = model["v"][at].astype(float) * quality_fm.np.array([[v] for _, v in x])
        products = scaled @ scaled.T
        pairs = sum(products[i, j] for i in range(len(x)) for j in range(i + 1, len(x))) if len(x) < 60 else quality_fm.np.triu(products, 1).sum()
        z = model["bias"] + sum(float(model["w"][i]) * v for i, v in x) + pairs
        score = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert got[doc]["score"] == pytest.approx(score, abs=2e-4) and got[doc]["predicted"] == int(got[doc]["score"] >= 0.7)


def test_held_out_is_the_named_quarter(spark, sf):
    for r in quality_fm.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels")).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


# ---- 5: n-gram Jaccard join
def _sets(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def _classes(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 3 * max(len(sets[a]), len(sets[b])) <= 4 * min(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_jaccard_classes_equal_brute_force(spark, odd, none):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for size in [1, 2, 4, 5, 6, 9, 12, 20, 40, 63, 64, 68, 70, 84, 86, 100, 130, 180, 260, 400, 700]:
        for _ in range(3):
            base = [rng.choice(words) for _ in range(size)]
            for changes in (0, 0, 1, 1, 2, 3, max(1, size // 40), size // 20, size // 12, size // 6):
                t = list(base)
                for _ in range(changes):
                    k = rng.randrange(len(t))
                    t[k : k + rng.choice([0, 1, 1, 2])] = [rng.choice(words)] * rng.choice([0, 1, 1])
                    t = t or ["x"]
                rows.append((n, " ".join(t)))
                n += 1
    shared = [rng.choice(words) for _ in range(60)]
    for _ in range(60):  # a passage that many documents have
        rows.append((n, " ".join([rng.choice(words) for _ in range(rng.randint(5, 60))] + shared)))
        n += 1
    chain = [rng.choice(words) for _ in range(200)]
    for _ in range(40):  # links in a chain: its ends are far apart
        k = rng.randrange(190)
        chain[k : k + 3] = [rng.choice(words) for _ in range(3)]
        rows.append((n, " ".join(chain)))
        n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_classes(df).collect()}
    sets = _sets(rows)
    want = _classes(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    out = parity_join.jaccard_classes(odd).collect()
    assert len(out) == odd.count() and {r["component_id"] for r in out if r["doc_id"] in (5, 6)} == {5}
    assert parity_join.jaccard_classes(none).count() == 0
    kept = parity_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 0


def _edited_copies(rng, words, size, copies, most):
    base = [rng.choice(words) for _ in range(size)]
    for _ in range(copies):
        t = list(base)
        for _ in range(rng.randint(0, most)):
            t[rng.randrange(size)] = rng.choice(words)
        yield " ".join(t)


def _equal_to_brute_force(spark, texts):
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = _sets(rows)
    want = _classes(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    return want


def test_a_phrase_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "HOT", 4)  # holders are counted in parts
    monkeypatch.setattr(parity_join, "BUCKET_SKETCHES", 2000)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    phrase = " ".join(rng.choice(words) for _ in range(40))
    texts = [f"{phrase} " + " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 5, 6, 8, 9, 12, 20, 100]))) for _ in range(90)]
    texts += [t + " " + phrase for t in _edited_copies(rng, words, 120, 60, 8)] + list(_edited_copies(rng, words, 60, 40, 3))
    want = _equal_to_brute_force(spark, texts)
    assert len(set(want.values())) < len(texts) - 60


def test_very_large_sets(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(9000)]
    texts = [t for most in (0, 150, 400) for t in _edited_copies(rng, words, 6000, 4, most)] + [" ".join(rng.choice(words) for _ in range(5200)) for _ in range(3)]
    want = _equal_to_brute_force(spark, texts)
    assert 3 < len(set(want.values())) < len(texts)


def test_sets_in_few_blocks_are_looked_up_by_tokens(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = list(enumerate(t for size in (5, 62, 90, 200, 300) for t in _edited_copies(rng, words, size, 8, size // 50)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = parity_join.memberships(docs).groupBy("sid").agg(F.min("doc_id").alias("rep"), *[F.max(c).alias(c) for c in ("n", "q0", "q1")]).withColumn("node", F.col("rep"))
    assert parity_join.token_pairs(docs, classes) is None
    few = F.col("node") % 3 == 0  # as if their tokens met in few blocks
    pairs = {(r["u"], r["v"]) for r in parity_join.token_pairs(docs, classes.withColumn("q0", F.when(few, 0).otherwise(F.col("q0")))).collect()}
    sets, ids = _sets(rows), [r["node"] for r in classes.collect()]
    want = {(a, b) for a in ids for b in ids if a < b and (a % 3 == 0 or b % 3 == 0) and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert len(want) > 20 and want <= pairs


def test_one_of_each_loses_no_text(spark, odd):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "a b c d e f g h i j k l m n o p q r s t u v")
    rows = [(1, a), (2, a), (2, b), (3, b), (7, c), (7, c), (8, c + " w"), (9, None), (9, None), (None, "alone in the world of words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = collections.Counter(map(tuple, parity_join.one_of_each(df).collect()))
    assert kept == collections.Counter([(1, a), (2, b), (7, c), (9, None), (9, None), (None, "alone in the world of words")])
    two = spark.createDataFrame([(2, a), (2, b)], "doc_id long, text string")
    assert parity_join.one_of_each(two).count() == 2
    assert sorted(r["doc_id"] or 0 for r in parity_join.one_of_each(odd).collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_stages_keep_columns_of_any_name(spark, sf, monkeypatch):
    """Columns named as the joins' own are handed on untouched."""
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    names = ["_text", "_id", "_of", "class", "key", "item", "h", "row", "sid", "node", "n"]
    rows = [(1, a), (2, a), (3, b), (3, b), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names])
    once = parity_join.one_of_each(df)
    assert once.columns == df.columns and collections.Counter(map(tuple, once.collect())) == collections.Counter(map(tuple, df.where("doc_id in (1, 4)").union(df.where("doc_id = 3").limit(1)).collect()))
    bench = spark.createDataFrame([(900, "What is the name of the longest river")], "item_id long, text string")
    some = df.union(df.where("doc_id = 4").withColumn("doc_id", F.lit(5).cast("long")).withColumn("text", F.lit("and What is the name of the longest river and more")))
    for size in (template_decon.BLOCK_WINDOWS, 1):
        monkeypatch.setattr(template_decon, "BLOCK_WINDOWS", size)
        left = template_decon.decontaminated(some, bench)
        assert left.columns == df.columns and collections.Counter(map(tuple, left.collect())) == collections.Counter(map(tuple, df.collect()))
    assert collections.Counter(map(tuple, pii_bootstrap.redacted(df).collect())) == collections.Counter(map(tuple, df.collect()))


def test_parity_sketch_bounds_the_difference():
    np = parity_join.np
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, 30, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        gap = int(np.bitwise_count((parity_join.parity_sketch(a) ^ parity_join.parity_sketch(b)).view(np.uint64)).sum())
        assert gap <= apart


# ---- 6: decontamination
def test_templates_catch_other_values(spark, odd, none):
    item = "If a train leaves at 9:30 with 120 passengers and travels 45 km in 2 hours, how far does Alice ride before Bob gets on with 120 bags"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    copy = "Intro words here. " + item + " and more"
    changed = "Intro. " + item.replace("120", "77").replace("9:30", "8:15").replace("Alice", "Carol").replace("45 km", "10 miles")
    broken = "Intro. " + item.replace("120 passengers", "77 passengers")  # the same value in one place only
    clean = "If a boat sails at noon and nobody knows how far it goes before night falls on the wide and quiet sea"
    docs = spark.createDataFrame([(1, copy), (2, changed), (3, broken), (4, clean), (5, None), (6, "")], "doc_id long, text string")
    rows = template_decon.contaminated_spans(docs, bench).collect()
    whole = {(r["doc_id"], r["verbatim"]) for r in rows if r["coverage"] > 0.9}
    assert (1, True) in whole and (2, False) in whole and not any(d == 3 for d, _ in whole)
    assert {r["doc_id"] for r in rows} <= {1, 2, 3}
    first = next(r for r in rows if r["doc_id"] == 1)
    assert copy[first["start"] : first["end"]].startswith(("If a train", "a train"))
    assert template_decon.contaminated_spans(odd, bench).count() == 0 and template_decon.contaminated_spans(docs, bench.limit(0)).count() == 0
    assert template_decon.decontaminated(none, bench).count() == 0
    assert {r["doc_id"] for r in template_decon.decontaminated(docs, bench).collect()} == {4, 5, 6} | ({3} if not any(r["doc_id"] == 3 for r in rows) else set())


def test_a_slot_conflict_splits_the_run(spark):
    fill = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    item = " ".join([*fill[:6], "12", *fill[6:56], "12", *fill[56:]])
    near = "Some 5 words. " + item.replace("12", "13", 1) + " and more"
    sum_ = "if he has 3 apples and she has 5 apples then how many are there"
    docs = [(1, near), (2, sum_.replace("3", "4").replace("5", "4")), (3, item)]
    bench = spark.createDataFrame([(1, item), (2, sum_)], "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows = collections.defaultdict(list)
    for r in template_decon.contaminated_spans(docs, bench).collect():
        rows[r["doc_id"]].append(r)
    assert max(r["n_tokens"] for r in rows[1]) == 55 and any(r["verbatim"] for r in rows[1])
    assert [(r["coverage"], r["slots_changed"]) for r in rows[2]] == [(1.0, 2)] and [r["coverage"] for r in rows[3]] == [1.0]
    assert template_decon.decontaminated(docs, bench).count() == 0


def test_verbatim_windows_need_no_literals(spark):
    items = ["12 + 7 = 19, 30 - 4 = 26, 5 * 5 = 25", "Alice 12 Bob 40 Carol 7 Dave 99 Erin 3", "What is the name of the longest river", "1914 Sarajevo 1918 Versailles 1929"]
    items.append("Then Carol took the bus home with 30 heavy old books")
    docs = [(k, f"some words and {t} and more") for k, t in enumerate(items)]
    docs += [(10, "we saw that then\nAlice took the bus home with 40 heavy old books"), (11, "some words and 1914 Sarajevo 1918 and more"), (12, "What was the name of a long river")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["verbatim"], r["coverage"]) for r in template_decon.contaminated_spans(docs, bench).collect()}
    assert got == {(k, k, True, 1.0) for k in range(5)} | {(10, 4, False, 1.0)}
    assert sorted(r["doc_id"] for r in template_decon.decontaminated(docs, bench).collect()) == [11, 12]


def test_decontamination_equals_brute_force(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    words = lambda t: [w for w in (x.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%$")).lower() for x in (t or "").split()) if w]
    items = {}
    for r in bench.collect():
        w = words(r["text"])
        for k in range(len(w) - 8):
            items.setdefault(tuple(w[k : k + 9]), r["item_id"])
    want = {r["doc_id"] for r in docs.collect() for w in [words(r["text"])] if any(tuple(w[k : k + 9]) in items for k in range(len(w) - 8))}
    got = {r["doc_id"] for r in template_decon.contaminated_spans(docs, bench).collect()}
    assert want <= got


def test_large_benchmarks_by_join(spark, sf, odd, none, monkeypatch):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    docs = docs.unionByName(docs.limit(20))  # repeated rows
    more = spark.createDataFrame([(900, "What is the name of the longest river"), (901, None), (902, "too short"), (903, "")], "item_id long, text string")
    bench = bench.unionByName(more).unionByName(bench.limit(2))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(5000, "some words and What is the name of the longest river and more"), (5001, None)], "doc_id long, text string"))
    spans, kept = (lambda: sorted(map(tuple, template_decon.contaminated_spans(docs, bench).collect()))), (lambda: sorted(r["doc_id"] for r in template_decon.decontaminated(docs, bench).collect()))
    whole, left = spans(), kept()
    monkeypatch.setattr(template_decon, "BLOCK_WINDOWS", 10)
    assert spans() == whole and kept() == left and any(r[1] == 900 for r in whole) and len(left) < docs.count()
    assert template_decon.contaminated_spans(odd, bench).count() == 0 and template_decon.decontaminated(none, bench).count() == 0


# ---- 7: languages
def test_languages(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = lang_ecoc.predict_languages(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("held_out and n > 30")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()
    rows = lang_ecoc.predict_languages(odd).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3, 7)) and len(rows) == odd.count()
    assert lang_ecoc.predict_languages(none).count() == 0


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9):
        c = lang_ecoc.codewords(n)
        assert len({tuple(r) for r in c.tolist()}) == n and (abs(c.sum(0)) < n).all()


def _plain_grams(text: str):
    """Hash cells of the n-grams: lower-cased bytes, gaps as one blank, none over two gaps."""
    data = bytearray(text.encode())
    letter = [bool(lang_ecoc._LETTER[b]) for b in data]
    low = []
    for k, b in enumerate(data):
        latin = k and data[k - 1] == 0xC3 and 0x80 <= b <= 0x9E
        low.append((b + 32 if latin or 65 <= b <= 90 else b) if letter[k] else 32)
    for n in lang_ecoc.LENGTHS:
        for k in range(len(low) - n + 1):
            if not any(not letter[j] and not letter[j + 1] for j in range(k, k + n - 1)):
                code = 0
                for b in low[k : k + n]:
                    code = (code * 257 + b) % 2**32
                h = (code * 0x9E3779B1 % 2**32) ^ (n * 0x85EBCA6B % 2**32)
                yield (h * 0xC2B2AE35 % 2**32) >> 32 - lang_ecoc.HASH_BITS


def test_decoding_equals_brute_force(spark, sf):
    """The registered query against bits and codewords evaluated one by one."""
    docs = table(spark, sf, "documents")
    model = lang_ecoc.fit(docs)
    got = {r["doc_id"]: r for r in queries.op7_language_ecoc(spark, sf).collect()}
    assert len(got) == docs.count()
    for doc, text in docs.select("doc_id", "text").collect():
        if not any(c.isalpha() for c in text or ""):
            assert (got[doc]["lang_pred"], got[doc]["score"]) == ("und", 0)
            continue
        grams = list(_plain_grams(text))
        losses = []
        for word in model["code"]:
            loss = 0.0
            for k, bit in enumerate(word):
                margin = sum(model["odds"][g][k] for g in grams) / max(1, len(grams)) * min(len(grams), lang_ecoc.EVIDENCE)
                loss += model["weight"][k] * math.log1p(math.exp(-margin * bit)) if -margin * bit < 30 else model["weight"][k] * -margin * bit
            losses.append(loss)
        best = losses.index(min(losses))
        score = 1 / sum(math.exp(losses[best] - x) for x in losses)
        assert got[doc]["lang_pred"] == model["langs"][best] and got[doc]["score"] == pytest.approx(score, abs=1e-6)


# ---- 8: token counts
def test_token_counts(spark, sf, odd, none):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    sp, splits = token_count.encoder(token_count.tokenizer_path())
    assert splits
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.token_counts(docs).collect())
    want = sorted((str(i), len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in docs.collect())
    assert got == want and token_count.token_counts(none).count() == 0


def test_safe_parts():
    rng = random.Random(9)
    sp, _ = token_count.encoder(token_count.tokenizer_path())
    for _ in range(40):
        t = "".join(rng.choice(["the", " ", "  ", "\n", "é", "漢", "▁", "<s>", "word", "x", " a "]) for _ in range(300))
        parts = token_count.safe_parts(t, 50)
        assert " ".join(parts) == t and sum(len(sp.encode(p)) for p in parts) == len(sp.encode(t))


# ---- 9: shards
def test_shards(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = byte_shards.byte_shards(docs, 40).collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    by = collections.defaultdict(list)
    home = collections.defaultdict(set)
    for r in rows:
        t = text[r["doc_id"]].encode()
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        by[r["shard"]].append(r)
        home[t].add(r["shard"])
    assert len(rows) == len(text) and set(by) == set(range(40)) and all(len(s) == 1 for s in home.values())
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    mean, largest = sum(r["size"] for r in rows) / 40, max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in rs) - mean) <= largest for rs in by.values())
    assert byte_shards.byte_shards(odd, 4).count() == odd.count() and byte_shards.byte_shards(none, 4).count() == 0


def _plain_shards(rows, shards):
    """(doc_id, size, crc, shard, slot) by running sums over all rows in one list."""
    groups = collections.defaultdict(list)
    for doc, text in rows:
        data = (text or "").encode()
        groups[hashlib.sha256(data).hexdigest()].append((doc, len(data) + 16, zlib.crc32(data)))
    weight = {d: sum(r[1] for r in g) for d, g in groups.items()}
    own: list = []
    while True:
        rest, left = sum(weight.values()) - sum(weight[d] for d in own), shards - len(own)
        found = [d for d in weight if weight[d] * left > rest] if left > 1 else []
        if len(found) == len(own) or len(found) >= shards:
            break
        own = found
    own.sort(key=lambda d: (-weight[d], d))
    out, before, slots = [], 0, collections.Counter()
    target = max(1, rest) / max(1, shards - len(own))
    for d in sorted(groups):
        if d in own:
            shard = own.index(d)
        else:
            shard = len(own) + min(shards - len(own) - 1, int((before + weight[d] / 2) // target))
            before += weight[d]
        for doc, size, crc in sorted(groups[d], key=lambda r: (r[0] is not None, r[0] or 0)):
            out.append((doc, size, crc, shard, slots[shard]))
            slots[shard] += 1
    return out


def test_shards_equal_running_sums(spark, sf, odd):
    """The registered query, odd rows, and a text of a third of all rows, against one list."""
    key = lambda r: (str(r[0]), *r[1:])
    plain = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    short = spark.createDataFrame([(i, None if i % 3 == 0 else f"text {i % 50} " * 9) for i in range(600)], "doc_id long, text string")
    for got, docs, n in ((queries.op9_byte_shards(spark, sf), table(spark, sf, "documents"), 40), (byte_shards.byte_shards(odd, 4), odd, 4), (byte_shards.byte_shards(short, 8), short, 8)):
        got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got.collect()]
        assert sorted(got, key=key) == sorted(_plain_shards(plain(docs), n), key=key)


def test_a_giant_group_has_a_shard(spark):
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"text number {i} " * (i % 7 + 1)) for i in range(900)]
    out = byte_shards.byte_shards(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    giant = {r["shard"] for r in out if r["doc_id"] % 3 == 0}
    assert len(giant) == 1 and {r["shard"] for r in out} == set(range(10))
    rest = collections.Counter()
    for r in out:
        if r["shard"] not in giant:
            rest[r["shard"]] += r["size"]
    assert max(rest.values()) < 1.2 * min(rest.values())


# ---- 10: fingerprints
def _edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        k = len(t) // 4
        yield i, len(t), hashlib.sha256((t[: len(t) - k] + u[:k] if k else t).encode()).hexdigest()


def test_edited_fingerprints(spark, sf, monkeypatch, none):
    monkeypatch.setattr(simhash_fp, "RANGE_ROWS", 17)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = simhash_fp.edited_fingerprints(docs).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(_edited([tuple(r) for r in docs.collect()]))
    plain = {r["doc_id"]: r["fingerprint"] for r in simhash_fp.fingerprint_docs(docs).collect()}
    assert all(r["fingerprint"] == plain[r["doc_id"]] for r in rows)
    by = sorted(rows, key=lambda r: r["doc_id"])
    for r, s in zip(by, by[1:] + by[:1]):
        assert r["near_next"] == 1 - bin(int(r["fingerprint"], 16) ^ int(s["fingerprint"], 16)).count("1") / 64
        assert r["near_edited"] == 1 - bin(int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).count("1") / 64
    assert simhash_fp.edited_fingerprints(none).count() == 0


def _plain_run(hashes) -> int:
    h = 0
    for x in hashes:
        h = (h * K._BASE + x) % 2**64
    return _plain_mix((h + len(hashes) * K._STEP) % 2**64)


def _plain_print(text: str) -> str:
    """The fingerprint by a vote of every term on every bit."""
    h = [_plain_hash(w) for w in _plain_words(text)]
    width = min(simhash_fp.TERM_WORDS, len(h))
    terms = collections.Counter(_plain_run(h[k : k + width]) for k in range(len(h) - width + 1)) if h else {}
    bits = 0
    for bit in range(64):
        votes = sum(round((1 + math.log2(n)) * simhash_fp.UNIT) * (1 if t >> bit & 1 else -1) for t, n in terms.items())
        bits |= (votes > 0) << bit
    return f"{bits:016x}"


def test_query_equals_votes(spark, sf):
    """The registered query's fingerprints, of texts and of edited texts, against votes bit by bit."""
    rows = sorted(((r["doc_id"], r["text"] or "") for r in table(spark, sf, "documents").collect()), key=lambda r: r[0])
    got = {r["doc_id"]: r for r in queries.op10_simhash(spark, sf).collect()}
    assert len(got) == len(rows)
    for (doc, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        assert got[doc]["fingerprint"] == _plain_print(t) and got[doc]["edited_fingerprint"] == _plain_print(t[: len(t) - k] + u[:k] if k else t)


def test_fingerprints_of_odd_rows(spark, odd):
    one = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = simhash_fp.edited_fingerprints(one).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(_edited([(r["doc_id"], r["text"]) for r in one.collect()]))
    everything = simhash_fp.edited_fingerprints(odd).collect()
    assert len(everything) == odd.count()
    single = simhash_fp.edited_fingerprints(one.where("doc_id = 5")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base:
        for _ in range(4):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    df = spark.createDataFrame([(f"{x:016x}",) for x in prints] * 2 + [(None,)], "fingerprint string")
    got = sorted((r["a"], r["b"], r["distance"]) for r in simhash_fp.neighbours(df).collect())
    names = sorted(f"{x:016x}" for x in prints)
    want = [(a, b, d) for k, a in enumerate(names) for b in names[k + 1 :] if (d := bin(int(a, 16) ^ int(b, 16)).count("1")) <= 3]
    assert got == want and len(want) > 50
    assert {r["fingerprint"] for r in simhash_fp.with_neighbours(df).collect()} == {x for a, b, _ in want for x in (a, b)}


def test_search_column(spark, odd, none):
    plain = {(str(r["doc_id"]), r["n_chars"]): r["fingerprint"] for r in simhash_fp.edited_fingerprints(odd).collect()}
    rows = simhash_fp.searched_fingerprints(odd).collect()
    bits = {int(f, 16) for f in plain.values()}
    assert len(rows) == odd.count() and simhash_fp.searched_fingerprints(none).count() == 0
    for r in rows:
        mine = int(r["fingerprint"], 16)
        assert r["near_other"] == any(0 < bin(mine ^ b).count("1") <= 3 for b in bits)


# ---- the pipeline
def test_pipeline_equals_its_stages(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels, bench = table(spark, sf, "documents"), table(spark, sf, "labels"), table(spark, sf, "benchmark")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality_fm.quality_scores(docs, labels).where("predicted = 1").collect()}
    classes = _classes(_sets([(i, rows[i]) for i in good]))
    unique = {i for i in good if classes[i] == i}
    dirty = {r["doc_id"] for r in template_decon.contaminated_spans(docs, bench).collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == unique - dirty and all(r["lossless"] for r in out.values())
    vocab = piece_lattice.vocabulary(token_count.tokenizer_path())
    for i, r in out.items():
        text = piece_lattice.decode(vocab, r["pieces"])
        assert hashlib.sha256(text.encode()).hexdigest() == r["text_sha256"] and _plain_base(text) == ""


def test_stages_take_odd_rows(spark, odd, none, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


# ---- queries with SQL
def test_queries_equal_sql(spark, sf):
    import duckdb

    from lodestrata.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    for name, sql in ORACLE_SQL.items():
        q = con.sql(sql)
        order = [q.columns.index(c) for c in sorted(q.columns)]
        df = QUERIES[name](spark, sf)
        assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in q.fetchall())
