"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (e-mail, IP address, card, phone) are found by their forms.  They seed the extraction: each
is an instance as a whole, and so is each identifier-like token or spaced group of digits that touches
none.  The last one, two and three words in front of instances are lexical patterns, and a graph joins
patterns with the values of the instances that stand behind them.  Scores pass between both sides for a few rounds: a
pattern is as trustworthy as its instances, an instance as the patterns that name it (of patterns that end in the same word, the best one).  Patterns of
high confidence and support then yield the identifiers behind them that no form has caught, but only where the pattern's words tell something: of all
places in the corpus where these words stand, at least the share ``LEAST_RATE`` must have an instance behind them, or else a common word in front of a few
entities would make identifiers of any number behind it.  Long
hexadecimal keys seed the kind ``secret``, which has no base form.

Spans are half-open ranges of code points.  The forms are written so that Java's matcher needs no
backtracking over long runs: a repetition that nothing can follow differently is possessive, and runs
are entered at their beginning (or where the previous match ended), which gives the same leftmost
matches.  Positions, containment and overlaps come from running totals over arrays, which are made chunk by
chunk (``running``), and pieces of a text from its blocks (``cut``), so the work grows with the text and its matches
and not with their product.

Defined results: a null text is empty and has no spans; equal rows get equal spans; what touches a
base span is not found, nor what lies within a longer found span; other columns are ignored by the report and kept by the redaction, which brings
``n_chars`` up to date; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.store import written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
FORMS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TOKEN = "[A-Za-z0-9._@/+-]"
#: An identifier-like token: six or more such characters, one of them a digit or an inner @.
CANDIDATE = rf"(?<!{_TOKEN})(?=[A-Za-z._@/+-]*+[0-9]|[A-Za-z._/+-]++@[A-Za-z]){_TOKEN}{{6,}}+"
#: Digits (with dots and hyphens) in two or more groups that spaces or brackets part, with no token at either end.
_GROUP = rf"[0-9]++(?:[.-][0-9]++)*+(?![._@/+-]*+{_TOKEN.replace('._@/+-', '_@')})"
SPACED = rf"(?<!{_TOKEN})[+(]{{0,2}}+{_GROUP}(?:(?:\)[\x20-]?|\x20\(?){_GROUP})++"
#: Words of a pattern at most, rounds of scoring, and what a pattern needs to be believed.
CONTEXT_WORDS, ROUNDS, LEAST_SEEDS, CONFIDENCE = 3, 3, 3, 0.7
#: Of the places where a pattern's words stand, the least share with an instance behind them.
LEAST_RATE = 0.1
#: Least length of what is no base entity, and characters in front of an instance that hold its context.
LEAST_LENGTH, CONTEXT_CHARS = 6, 48
SECRET_LENGTH = 32
BROADCAST_ROWS = 100_000
#: Items in a chunk of a running total, and code points in a block of a text.
CHUNK, BLOCK_CHARS = 128, 2048

_SPANS = "array<struct<s:int,e:int,v:string,before:string>>"


def let(value: Column, use) -> Column:
    """use(value), where value is computed once for each row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, measure, both, zero: Column) -> Column:
    """[(at, x)] for the items x: ``at`` is ``both`` over the measures of all items before x.

    Totals of chunks come first, then those before each chunk, then those within the chunks.
    """

    def over(items, at, value, keep):
        start = F.struct(at.alias("at"), F.transform(F.slice(items, 1, 0), lambda x: keep(at, x)).alias("out"))
        step = lambda acc, x: F.struct(both(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(keep(acc["at"], x))).alias("out"))
        return F.aggregate(items, start, step, lambda acc: acc["out"])

    pair = lambda at, x: F.struct(at.alias("at"), x.alias("x"))

    def of(items):
        last = F.ceil(F.size(items) / CHUNK).cast("int") - 1
        chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))
        total = lambda c: F.aggregate(c, zero, lambda acc, x: both(acc, measure(x)))
        before = lambda chunks: over(F.transform(chunks, total), zero, lambda t: t, lambda at, _: at)
        several = let(chunks, lambda chunks: F.flatten(F.zip_with(chunks, before(chunks), lambda c, at: over(c, at, measure, pair))))
        return F.when(F.size(items) > CHUNK, several).otherwise(over(items, zero, measure, pair))

    return let(items, of)


def blocks(text: Column) -> Column:
    """A text in pieces of BLOCK_CHARS code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))


def cut(parts: Column, s: Column, e: Column) -> Column:
    """The code points s to e of a text in blocks."""
    first = F.floor(s / BLOCK_CHARS).cast("int")
    some = F.slice(parts, first + 1, F.floor((e - 1) / BLOCK_CHARS).cast("int") - first + 1)
    return F.when(e > s, F.substring(F.array_join(some, ""), s - first * BLOCK_CHARS + 1, e - s)).otherwise("")


def matches(text: Column, parts: Column, form: str) -> Column:
    """Leftmost non-overlapping matches: s, e, v, and the last CONTEXT_CHARS characters before it.

    The lengths around the matches come from a split by the same form; both give the positions.
    """
    found, around = F.regexp_extract_all(text, F.lit(form), F.lit(0)), F.split(text, form, -1)
    both = let(found, lambda found: F.zip_with(found, F.slice(around, 1, F.size(found)), lambda v, b: F.struct(v.alias("v"), F.char_length(b).alias("b"))))
    placed = running(both, lambda m: m["b"] + F.char_length(m["v"]), lambda a, n: a + n, F.lit(0))

    def span(at, v):
        return F.struct(at.alias("s"), (at + F.char_length(v)).alias("e"), v.alias("v"), cut(parts, F.greatest(at - CONTEXT_CHARS, F.lit(0)), at).alias("before"))

    return F.transform(placed, lambda m: span(m["at"] + m["x"]["b"], m["x"]["v"]))


def outer(spans: Column) -> Column:
    """Those of the spans (structs with s and e) that no longer one contains, by start."""
    by = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("less"), x.alias("x"))))
    # the greater end, of equal ones the lesser start
    code = lambda m: F.shiftleft(-m["less"].cast("long"), 31) - m["s"]
    first = running(by, code, lambda a, b: F.greatest(a, b), F.lit(-(1 << 62)))
    return F.transform(F.filter(first, lambda m: m["at"] <= code(m["x"])), lambda m: m["x"]["x"])


def apart(spans: Column, base: Column) -> Column:
    """Those of the spans (s, e, v, before) that overlap no base span: none that begins before their end ends after their start."""
    mark = lambda at, kind, s, e, v, before: F.struct(at.alias("at"), F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), v.alias("v"), before.alias("before"))
    none = F.lit("")
    all_ = F.array_sort(F.concat(F.transform(spans, lambda m: mark(m["e"], 0, m["s"], m["e"], m["v"], m["before"])), F.transform(base, lambda b: mark(b["s"], 1, b["s"], b["e"], none, none))))
    ends = running(all_, lambda x: F.when(x["kind"] == 1, x["e"]).otherwise(0), lambda a, b: F.greatest(a, b), F.lit(0))
    return F.transform(F.filter(ends, lambda m: (m["x"]["kind"] == 0) & (m["at"] <= m["x"]["s"])), lambda m: m["x"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    place = lambda i: F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(place(i))).otherwise(place(i)))
    return total % 10 == 0


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda v: F.char_length(_digits(v)).between(12, 19) & luhn(_digits(v)),
    "phone": lambda v: F.char_length(_digits(v)).between(9, 15),
}
_MAY = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9][ -]?[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}


def _none() -> Column:
    return F.array().cast(_SPANS)


def base_spans(text: Column, parts: Column, kind: str) -> Column:
    valid = _VALID[kind]
    return F.when(_MAY[kind](text), F.filter(matches(text, parts, FORMS[kind]), lambda m: valid(m["v"]))).otherwise(_none())


def _tagged(spans: Column, kind: str) -> Column:
    """Spans as (s, k, kind, e), which sort by start and then as the kinds are listed."""
    return F.transform(spans, lambda m: F.struct(m["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), m["e"].alias("e")))


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, of sorted structs (s, k, kind, e)."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def _instance(s: Column, e: Column, v: Column, before: Column, seed: Column, base: bool) -> Column:
    """A value with its patterns: the shape of the value and the last words in front of it, one up to CONTEXT_WORDS."""
    tail = F.regexp_replace(F.lower(before), r"\s+", " ")
    contexts = F.array(*[F.regexp_extract(tail, rf"((?:\S+ ){{0,{n}}}\S* ?)$", 1) for n in range(CONTEXT_WORDS)])
    contexts = F.array_distinct(F.filter(contexts, lambda c: F.trim(c) != ""))
    shape = F.when(v.rlike(r"^[\x20()0-9+-]+$"), "digits").when(v.rlike("^[0-9a-f]+$"), "hex").when(F.contains(v, F.lit("@")), "mail").otherwise("mixed")
    seed = F.coalesce(seed, F.when((shape == "hex") & (F.char_length(v) >= SECRET_LENGTH), "secret"))
    return F.struct(s.alias("s"), e.alias("e"), v.alias("v"), F.transform(contexts, lambda c: F.concat_ws(" ", shape, c)).alias("patterns"), seed.alias("seed"), F.lit(base).alias("base"))


def _seeds(spans: dict[str, Column]) -> Column:
    """Instances of the whole base spans by kind, but of those within a longer base span."""
    named = lambda kind: lambda m: m.withField("kind", F.lit(kind))
    every = F.concat(*[F.transform(found, named(kind)) for kind, found in spans.items()])
    return F.transform(outer(every), lambda m: _instance(m["s"], m["e"], m["v"], m["before"], m["kind"], True))


def _candidates(text: Column, parts: Column, form: str, base: Column) -> Column:
    """Instances of a form that touch no base span."""
    found = F.when(text.rlike("[0-9@]"), matches(text, parts, form)).otherwise(_none())
    ended = F.transform(found, lambda m: m.withField("v", F.regexp_replace(m["v"], "[._@/+-]+$", "")))
    ended = F.transform(ended, lambda m: m.withField("e", m["s"] + F.char_length(m["v"])))
    fits = F.filter(ended, lambda m: F.char_length(m["v"]) >= LEAST_LENGTH)
    return F.transform(apart(fits, base), lambda m: _instance(m["s"], m["e"], m["v"], m["before"], F.lit(None).cast("string"), False))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, base spans and instances (``candidates``) of every row: one pass, no shuffle."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("parts", blocks(F.col("text")))
    rows = rows.withColumns({f"m_{k}": base_spans(F.col("text"), F.col("parts"), k) for k in KINDS})
    rows = rows.withColumn("base", F.array_sort(F.concat(*[_tagged(F.col(f"m_{k}"), k) for k in KINDS])))
    instances = [_seeds({k: F.col(f"m_{k}") for k in KINDS}), *[_candidates(F.col("text"), F.col("parts"), form, F.col("base")) for form in (CANDIDATE, SPACED)]]
    rows = rows.withColumn("candidates", F.filter(F.concat(*instances), lambda c: F.size(c["patterns"]) > 0))
    return rows.select("doc_id", F.xxhash64("text").alias("digest"), *[F.size(f"m_{k}").cast("long").alias(f"n_{k}") for k in KINDS], "base", "candidates")


def _small(side: DataFrame) -> DataFrame:
    """A written table that is sent to all if it is small, and shuffled if not."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def occurrences(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, places: how often the words of contexts (whole words, each with a space behind it) stand in all texts.

    Only places of the contexts' last words are made rows of one to CONTEXT_WORDS words; they are counted partially before the shuffle.
    """
    words = F.split(F.regexp_replace(F.lower("text"), r"\s+", " "), " ")
    ahead = [F.concat(F.array_repeat(F.lit(""), k), F.col("words")) for k in range(CONTEXT_WORDS)]
    rows = docs.where("text is not null").select(words.alias("words")).select(F.explode(F.arrays_zip(*[a.alias(f"w{k}") for k, a in enumerate(ahead)])).alias("w")).select("w.*").where("w0 is not null and w0 != ''")
    ends = contexts.select(F.element_at(F.split(F.rtrim("context"), " "), -1).alias("w0")).distinct()
    rows = rows.join(_small(written(ends, "last-words")), "w0", "left_semi")
    grams, said = [], F.lit("")
    for k in range(CONTEXT_WORDS):
        said = F.concat(F.col(f"w{k}"), F.lit(" "), said)
        grams.append(F.when(F.col(f"w{k}") != "", said))
    grams = rows.select(F.explode(F.array_compact(F.array(*grams))).alias("context")).groupBy("context").agg(F.count("*").alias("places"))
    return grams.join(_small(contexts), "context", "left_semi")


def telling(trust: DataFrame, times: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the patterns (pattern, ...) whose words are followed by an instance often enough; ``times``: pattern, times.

    A pattern that ends within a word, as at a quote, stands right in front of its values and needs no such test.
    """
    context = F.regexp_replace("pattern", r"^\S+ ", "")
    trust = written(trust.join(times, "pattern").withColumn("context", context), "trusted")
    whole = trust.where("context like '% '")
    if whole.isEmpty():
        return trust.drop("times", "context")
    known = written(occurrences(docs, written(whole.select("context").distinct(), "contexts")), "occurrences")
    rated = trust.join(_small(known), "context", "left").where(f"context not like '% ' or places is null or times >= {LEAST_RATE} * places")
    return rated.drop("times", "context", "places")


def trusted_patterns(scan: DataFrame, docs: DataFrame) -> DataFrame:
    """pattern, kind, confidence of the patterns that the graph of patterns and instances supports and whose words tell something."""
    rows = scan.where(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).select(F.explode("c.patterns").alias("pattern"), "c.v", "c.seed")
    edges = written(rows.groupBy("pattern", "v").agg(F.max("seed").alias("seed"), F.count("*").alias("times")), "pattern-instances")
    times = edges.groupBy("pattern").agg(F.sum("times").alias("times"))
    # only patterns that seeds induce can gain confidence
    induced = edges.where("seed is not null").groupBy("pattern").agg(F.count("*").alias("seeds"), F.mode("seed", deterministic=True).alias("kind")).where(F.col("seeds") >= LEAST_SEEDS)
    # patterns of the same last word tell the same of a value, so the best of them counts
    edges = edges.join(_small(written(induced, "induced-patterns")), "pattern").withColumn("root", F.regexp_extract("pattern", r"(\S* ?)$", 1))
    edges = written(edges, "induced")
    score = edges.select("v", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("score")).groupBy("v").agg(F.max("score").alias("score"))
    trust = None
    for _ in range(ROUNDS):
        trust = edges.join(score, "v").groupBy("pattern", "kind", "seeds").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"))
        trust = written(trust, "trust")
        named = edges.join(_small(trust.select("pattern", "confidence")), "pattern").groupBy("v", "root").agg(F.max(F.col("seed").isNotNull()).alias("sure"), F.max("confidence").alias("confidence"))
        named = named.groupBy("v").agg(F.max("sure").alias("sure"), (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("named"))
        score = named.select("v", F.when(F.col("sure"), 1.0).otherwise(F.col("named")).alias("score"))
    return telling(trust.where(F.col("confidence") >= CONFIDENCE).select("pattern", "kind", "confidence"), times, docs)


def found_spans(scan: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, digest, found: what trusted patterns yield beyond the base spans."""
    rows = scan.where(F.size("candidates") > 0).select("doc_id", "digest", F.explode("candidates").alias("c")).where("not c.base")
    rows = rows.select("doc_id", "digest", "c.s", "c.e", F.explode("c.patterns").alias("pattern"))
    # the kind is that of the most trusted pattern, of equal ones the longest
    by = F.struct(F.round("confidence", 9), F.char_length("pattern"), "pattern")
    got = rows.join(_small(trusted_patterns(scan, docs)), "pattern").groupBy("doc_id", "digest", "s", "e").agg(F.max_by("kind", by).alias("kind"))
    span = F.struct(F.col("s"), F.lit(len(KINDS)).alias("k"), F.when(F.col("kind") == "secret", "secret").otherwise(F.concat(F.lit("ctx_"), F.col("kind"))).alias("kind"), F.col("e"))
    spans = got.groupBy("doc_id", "digest").agg(F.collect_set(span).alias("all"))
    return spans.select("doc_id", "digest", F.array_sort(outer(F.col("all"))).alias("found"))


def _with_found(rows: DataFrame, scan: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (doc_id, digest, ...) with their found spans; few found rows are sent to all, many are shuffled."""
    found = written(found_spans(scan, docs).withColumnsRenamed({"doc_id": "f_id", "digest": "f_digest"}), "found-spans")
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    on = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest"))
    nothing = F.array().cast("array<struct<s:int,k:int,kind:string,e:int>>")
    return rows.join(side, on, "left").withColumn("found", F.coalesce("found", nothing)).drop("f_id", "f_digest")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (base and found), n_found of every row."""
    scan = written(scanned(docs), "scanned")
    rows = _with_found(scan.drop("candidates"), scan, docs)
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, where [KIND] stands for every span; n_chars is brought up to date."""
    scan = written(scanned(docs), "scanned")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"), "doc_id", text.alias("whole"), F.xxhash64(text).alias("digest"), blocks(text).alias("parts"))
    rows = rows.select("row", "doc_id", "digest", "parts", F.concat(*[_tagged(base_spans(F.col("whole"), F.col("parts"), k), k) for k in KINDS]).alias("base"))
    rows = _with_found(rows, scan, docs).select("row", "parts", F.array_sort(F.concat("base", "found")).alias("spans"))
    text, parts = F.col("row.text"), F.col("parts")
    # of spans that overlap the first one gives the name; what is left of the text runs from the furthest end so far
    ends = running(F.col("spans"), lambda x: x["e"], lambda a, b: F.greatest(a, b), F.lit(0))
    pieces = F.transform(F.filter(ends, lambda m: m["x"]["s"] >= m["at"]), lambda m: F.concat(cut(parts, m["at"], m["x"]["s"]), F.lit("["), F.upper(m["x"]["kind"]), F.lit("]")))
    furthest = F.array_max(F.transform("spans", lambda x: x["e"]))
    whole = F.array_join(F.concat(pieces, F.array(cut(parts, furthest, F.char_length(text)))), "")
    touched = F.size("spans") > 0
    rows = rows.select("row", touched.alias("touched"), F.when(touched, whole).otherwise(text).alias("fresh"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("fresh")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("touched"), F.char_length("fresh").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[c.alias(name) for name, c in columns.items()])
