"""Audit, localisation, edit, store and change-stream queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.icu import brace_balance, icu_parse, lacks_other
from lodestrata.operators import audit as A
from lodestrata.operators import edits as E
from lodestrata.operators import l10n as T
from lodestrata.operators import lines as L
from lodestrata.plans.adapters import FILES, LINES, files, lines_sql, query, table
from lodestrata.sources import store as St
from lodestrata.streaming import changes as C

# ---- audits ----------------------------------------------------------------------------------------------


@query(f"SELECT path, line, mark FROM {LINES}, (SELECT unnest(['token =', '!!', '|', '***', 'License']) AS mark) WHERE contains(text, mark)")
def rule_table_hits(spark, sf_dir):
    return A.rule_hits(L.lines(files(spark, sf_dir)), ("token =", "!!", "|", "***", "License")).select("path", "line", "mark")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("content"))


_XMLISH = "(SELECT page_id || '.xml' AS path, replace(html, '<a href=', '<a android:text=') AS content FROM pages)"


@query(f"""WITH l AS (SELECT path, line, string_split_regex(trim(text), '["'']') AS p FROM {lines_sql(_XMLISH)} WHERE NOT starts_with(trim(text), '<!--')),
    v AS (SELECT path, line, list_filter(range(2, len(p)), lambda k: p[k] <> '' AND NOT (contains(p[k], '@') OR contains(p[k], '?') OR contains(p[k], '{{')) AND ends_with(rtrim(p[k - 1]), '=')
      AND (ends_with(rtrim(rtrim(p[k - 1])[:-2]), 'android:text') OR ends_with(rtrim(rtrim(p[k - 1])[:-2]), 'android:hint') OR ends_with(rtrim(rtrim(p[k - 1])[:-2]), 'android:contentDescription'))) AS hit, p FROM l)
    SELECT path, line, 'hardcoded_text' AS type, trim(p[hit[1]]) AS value FROM v WHERE len(hit) > 0 AND length(trim(p[hit[1]])) > 1 AND regexp_matches(p[hit[1]], '\\pL')""")
def hardcoded_values(spark, sf_dir):
    f = _pages(spark, sf_dir).select(F.concat(F.col("page_id").cast("string"), F.lit(".xml")).alias("path"), F.replace("content", F.lit("<a href="), F.lit("<a android:text=")).alias("content"))
    return A.hardcoded_values(L.lines(f))


@query("""WITH b AS (SELECT doc_id, md5(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS fingerprint, length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS length FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY fingerprint) AS n FROM b WHERE length >= 50)
    SELECT fingerprint, any_value(n) AS n, CAST(max(length) AS INTEGER) AS length, min(doc_id) AS first, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (r BETWEEN 2 AND 4) AS others FROM r WHERE n > 1 GROUP BY fingerprint""")
def duplicate_bodies(spark, sf_dir):
    return A.duplicate_bodies(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")), 50)


def _trees(spark, sf_dir):
    """Each order as a tree: the order, its lines below it, and the line's part type below that."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    roots = o.select(F.col("o_orderkey").alias("path"), F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("ord"), F.lit(0).alias("depth"), F.col("o_orderstatus").alias("name"))
    n = F.monotonically_increasing_id() + 1
    kids = li.select(F.col("l_orderkey").alias("path"), n.alias("node_id"), F.lit(0).cast("long").alias("parent_id"), F.col("l_linenumber").alias("ord"), F.lit(1).alias("depth"), F.col("l_returnflag").alias("name"), "l_partkey")
    leaves = kids.join(p, kids["l_partkey"] == p["p_partkey"]).select("path", (-F.col("node_id")).alias("node_id"), F.col("node_id").alias("parent_id"), F.lit(1).alias("ord"), F.lit(2).alias("depth"), F.col("p_type").alias("name"))
    return roots.unionByName(kids.drop("l_partkey")).unionByName(leaves)


@query("""WITH s AS (SELECT l_orderkey, string_agg(l_returnflag || '(' || p_type || ')', ',' ORDER BY l_returnflag || '(' || p_type || ')') AS inner_, count(*) AS k FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
    SELECT signature, size, count(*) AS n FROM (SELECT o_orderstatus || coalesce('(' || inner_ || ')', '') AS signature, 1 + 2 * coalesce(k, 0) AS size FROM orders LEFT JOIN s ON l_orderkey = o_orderkey) WHERE size >= 3 GROUP BY signature, size HAVING count(*) > 1""")
def duplicate_signatures(spark, sf_dir):
    return A.duplicate_subtrees(_trees(spark, sf_dir), 3, "ts")


@query(f"""WITH l AS (SELECT path, line, trim(replace(replace(text, 'Th', 'if '), 'Er', 'return ')) AS t FROM {lines_sql("(SELECT conv_id || chr(47) || turn AS path, text AS content FROM conversations)")}),
    k AS (SELECT path, line, t, CASE WHEN t = '' OR starts_with(t, '//') THEN NULL WHEN starts_with(t, 'if ') OR starts_with(t, 'else if') OR starts_with(t, 'switch') THEN CASE WHEN contains(t, '.isEmpty') THEN 'validation' ELSE 'conditional' END
      WHEN starts_with(t, 'for ') OR starts_with(t, 'while ') THEN 'loop' WHEN starts_with(t, 'try') OR starts_with(t, 'catch') OR starts_with(t, 'throw ') OR contains(t, ' catch ') THEN 'error_handling' WHEN starts_with(t, 'return ') THEN 'return' END AS kind FROM l)
    SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY line) AS INTEGER) AS step, line, kind FROM k WHERE kind IS NOT NULL""")
def logic_flow_steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.col("text").alias("content"))
    rows = L.lines(c).withColumn("text", F.replace(F.replace("text", F.lit("Th"), F.lit("if ")), F.lit("Er"), F.lit("return ")))
    return L.logic_flow(rows).select("path", "step", "line", "kind")


@query("""SELECT event_id, lower(CASE WHEN event_id % 3 = 0 THEN 'error' WHEN event_id % 3 = 1 THEN 'warning' ELSE 'info' END) AS severity, 'lib/' || event_type || '.dart' AS file, CAST(user_id AS INTEGER) AS line, CAST(1 + event_id % 7 AS INTEGER) AS col FROM events WHERE event_id % 4 < 2
    UNION ALL SELECT event_id, 'error', 'src/' || event_type || '.ts', CAST(user_id AS INTEGER), CAST(1 + event_id % 7 AS INTEGER) FROM events WHERE event_id % 4 = 2""")
def diagnostics_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = lambda c: F.col(c).cast("string")
    col = (1 + F.col("event_id") % 7).cast("string")
    severity = F.when(F.col("event_id") % 3 == 0, "error").when(F.col("event_id") % 3 == 1, "Warning").otherwise("info")
    dart = F.concat(F.lit("  "), severity, F.lit(" • some finding • lib/"), "event_type", F.lit(".dart:"), s("user_id"), F.lit(":"), col, F.lit(" • code"))
    tsc = F.concat(F.lit("src/"), "event_type", F.lit(".ts("), s("user_id"), F.lit(","), col, F.lit("): error TS2345: mismatch"))
    text = F.when(F.col("event_id") % 4 < 2, dart).when(F.col("event_id") % 4 == 2, tsc).otherwise("Analyzing...")
    return A.diagnostics(e.select("event_id", text.alias("text"))).select("event_id", "severity", "file", "line", "col")


@query("SELECT metric, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM (SELECT lang, CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 2000 THEN 'middle' ELSE 'long' END AS metric FROM documents) GROUP BY metric")
def parity_pivot(spark, sf_dir):
    size = F.when(F.char_length("text") < 500, "short").when(F.char_length("text") < 2000, "middle").otherwise("long")
    return A.parity_matrix(table(spark, sf_dir, "documents").select(F.col("lang").alias("engine"), size.alias("metric"), F.col("doc_id").alias("name")), ["de", "en", "es", "fr"])


@query("SELECT DISTINCT l_orderkey AS path, CAST(3 AS INTEGER) AS depth FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey")
def widget_depth(spark, sf_dir):
    return A.depth_violations(_trees(spark, sf_dir), 2)


@query("""WITH f AS (SELECT CASE event_type WHEN 'error' THEN 'async' WHEN 'click' THEN 'callback' WHEN 'view' THEN 'widget' ELSE 'data' END AS category FROM events)
    SELECT c.category, count(f.category) AS n FROM (SELECT unnest(['comment', 'callback', 'widget', 'data', 'async', 'input']) AS category) c LEFT JOIN f ON f.category = c.category GROUP BY c.category""")
def category_breakdown_zero_fill(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "async").when(F.col("event_type") == "click", "callback").when(F.col("event_type") == "view", "widget").otherwise("data")
    return A.category_breakdown(table(spark, sf_dir, "events").select(kind.alias("category")))


@query("""WITH f AS (SELECT doc_id FROM documents WHERE contains(text, '!!') OR contains(text, '|') OR contains(text, '***')), t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
    c AS (SELECT count(*) FILTER (f.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) AS tp, count(*) FILTER (t.doc_id IS NULL) AS fp, count(*) FILTER (f.doc_id IS NULL) AS fn FROM f FULL JOIN t ON f.doc_id = t.doc_id)
    SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1 FROM c""")
def precision_recall(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    marks = F.contains("text", F.lit("!!")) | F.contains("text", F.lit("|")) | F.contains("text", F.lit("***"))
    return A.precision_recall(d.where(marks), table(spark, sf_dir, "labels").where("quality = 0"), ["doc_id"])


# ---- localisation: documents as entries (key = source, locale = lang, the least doc_id counts) ----------------
_ENTRIES = "(SELECT lang || '.arb' AS path, lang AS locale, source || '_' || (doc_id % 7) AS key, arg_min(text, doc_id) AS value FROM documents WHERE text IS NOT NULL GROUP BY ALL)"


def _entries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    key = F.concat("source", F.lit("_"), (F.col("doc_id") % 7).cast("string"))
    return d.groupBy(F.concat("lang", F.lit(".arb")).alias("path"), F.col("lang").alias("locale"), key.alias("key")).agg(F.min_by("text", "doc_id").alias("value"))


_MESSAGE = "replace(replace(value, 'The ', '{the} '), ' to ', ' {to, number} ')"


@query(f"""WITH p AS (SELECT path, key, list_sort(list_distinct(regexp_extract_all({_MESSAGE}, '\\{{\\s*([A-Za-z_]\\w*)\\s*[,}}]', 1))) AS names FROM {_ENTRIES})
    SELECT p.path, p.key FROM p JOIN p b ON b.key = p.key AND b.path = (SELECT min(path) FROM p) WHERE p.names <> b.names""")
def placeholder_mismatch(spark, sf_dir):
    v = F.replace(F.replace("value", F.lit("The "), F.lit("{the} ")), F.lit(" to "), F.lit(" {to, number} "))
    return T.message_issues(_entries(spark, sf_dir).withColumn("value", v), "rs").where("issue = 'placeholder_mismatch'").select("path", "key")


@query(f"WITH t AS (SELECT * FROM {_ENTRIES}) SELECT f.path, k.key FROM (SELECT DISTINCT path FROM t) f, (SELECT DISTINCT key FROM t) k WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.path = f.path AND t.key = k.key)")
def missing_keys(spark, sf_dir):
    return T.missing_keys(_entries(spark, sf_dir)).select("path", "key")


@query(f"WITH t AS (SELECT * FROM {_ENTRIES}), s AS (SELECT key, value FROM t WHERE locale = 'en'), l AS (SELECT DISTINCT locale FROM t WHERE locale <> 'en') SELECT s.key, s.value, string_agg(l.locale, ',' ORDER BY l.locale) AS locales FROM s, l WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.locale = l.locale AND t.key = s.key) GROUP BY s.key, s.value")
def missing_payload(spark, sf_dir):
    return T.missing_payload(_entries(spark, sf_dir)).select("key", "value", "locales")


@query("""WITH keys AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_$][\\w$]*')) AS key FROM benchmark), used AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_$][\\w$]*')) AS key FROM documents)
    SELECT key FROM keys WHERE key NOT IN (SELECT key FROM used)""")
def unused_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))).alias("key"))
    return T.unused_keys(keys, files(spark, sf_dir))


@query("SELECT event_id, CAST(length(replace(m, '}', '')) - length(replace(m, '{', '')) AS INTEGER) AS balance, (contains(m, ', plural,') AND NOT contains(m, 'other{')) AS lacks_other FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{n, plural, one{' || event_type || '}' ELSE props END AS m FROM events)")
def icu_balance(spark, sf_dir):
    m = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{n, plural, one{"), "event_type", F.lit("}"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", brace_balance(F.col("m")).alias("balance"), lacks_other(F.col("m")).alias("lacks_other"))


@query()
def icu_parse_messages(spark, sf_dir):
    m = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{n, plural, one{"), "event_type", F.lit("}}"))).otherwise(F.concat(F.lit("{"), "event_type", F.lit("} "), F.col("value").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", icu_parse(m).alias("p")).select("event_id", F.array_join("p.args", ",").alias("args"), F.size("p.errors").alias("errors"))


# ---- store --------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return St.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["event_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def prune_missing(spark, sf_dir):
    return St.pruned(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"""WITH a AS (SELECT path, md5(content) AS h FROM {FILES} WHERE NOT path LIKE 'src1/%'), b AS (SELECT path, CASE WHEN path LIKE '%7' THEN md5(content || 'x') ELSE md5(content) END AS h FROM {FILES} WHERE NOT path LIKE 'src2/%')
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def hash_changed(spark, sf_dir):
    f = files(spark, sf_dir)
    old = f.where("path not like 'src1/%'").select("path", F.md5("content").alias("hash"))
    new = f.where("path not like 'src2/%'").select("path", F.when(F.col("path").like("%7"), F.md5(F.concat("content", F.lit("x")))).otherwise(F.md5("content")).alias("hash"))
    return St.changed(old, new)


@query("""WITH g AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
    r AS (SELECT *, sum(b) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT user_id, event_type, CAST(epoch_us(min(ts)) AS BIGINT) AS began, CAST(epoch_us(max(ts) + INTERVAL 6 HOUR) AS BIGINT) AS fires, count(*) AS n FROM r GROUP BY user_id, event_type, run""")
def debounce_trailing(spark, sf_dir):
    d = C.debounced(table(spark, sf_dir, "events"), ["user_id", "event_type"], 6 * 3600 * 1000)
    return d.select("user_id", "event_type", F.unix_micros("began").alias("began"), F.unix_micros("fires").alias("fires"), "n")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, epoch_us(ts) // 1000 AS t FROM events),
    a AS (SELECT user_id, event_type, min(t) AS t FROM e GROUP BY user_id, event_type
      UNION ALL SELECT a.user_id, a.event_type, (SELECT min(e.t) FROM e WHERE e.user_id = a.user_id AND e.event_type = a.event_type AND e.t >= a.t + 21600000) FROM a WHERE a.t IS NOT NULL)
    SELECT user_id, event_type, CAST(t AS BIGINT) AS t FROM a WHERE t IS NOT NULL""")
def throttle_leading(spark, sf_dir):
    t = C.throttled(table(spark, sf_dir, "events"), ["user_id", "event_type"], 6 * 3600 * 1000)
    return t.select("user_id", "event_type", F.unix_millis("at").alias("t"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS slot FROM events WHERE event_type = 'error') WHERE slot <= 5")
def error_ring_buffer(spark, sf_dir):
    return St.ring_buffer(table(spark, sf_dir, "events").where("event_type = 'error'"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


# ---- edits --------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, text, (length(text) - length(replace(text, 'Licensed', ''))) // 8 AS n FROM documents)
    SELECT doc_id, CAST(CASE WHEN n = 1 THEN 1 ELSE 0 END AS INTEGER) AS replacements, CASE WHEN n = 0 THEN 'not found' WHEN n <> 1 THEN 'found ' || n || ' times' END AS error, md5(CASE WHEN n = 1 THEN replace(text, 'Licensed', 'Offered') ELSE text END) AS digest FROM d""")
def edits_unique_replace(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return E.replaced(d, "Licensed", "Offered").select("doc_id", F.col("replacements").cast("int").alias("replacements"), "error", F.md5("content").alias("digest"))


@query("""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents)
    SELECT doc_id, CASE WHEN len(p) < 3 THEN 'outside the file' END AS error, md5(CASE WHEN len(p) < 3 THEN text ELSE array_to_string(list_concat(p[1:1], ['new line'], p[4:]), chr(10)) END) AS digest FROM d""")
def line_replace(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return E.lines_replaced(d, 2, 3, "new line").select("doc_id", "error", F.md5("content").alias("digest"))


# ---- blocks -------------------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT path, 2 AS first, 2 + length(path) % 3 AS last FROM {FILES}), l AS (SELECT * FROM {LINES})
    SELECT s.path, md5(string_agg(text, chr(10) ORDER BY line)) AS digest FROM s JOIN l ON l.path = s.path AND line BETWEEN first AND last GROUP BY s.path""")
def code_block_slices(spark, sf_dir):
    f = files(spark, sf_dir)
    symbols = f.select("path", F.lit("function").alias("kind"), F.lit("f").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(2).alias("line"), (2 + F.char_length("path") % 3).alias("line_end"))
    return L.code_blocks(symbols, L.lines(f), "f").select("path", F.md5("source").alias("digest"))
