"""The registered queries of this subpackage: each operator applied to its whole table, and SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import asof, chat, common, decontaminate, exact, html, mixing, near, packing, quality, ranked, sharding, substring, urls

#: SQL of a text's words, as ``common.words_of``.
_WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SHARDS = 24
MIX_WEIGHTS = [5, 2, 1]
MIX_EPOCHS = 3


PACK_WINDOW = 4096
PACK_END = 2


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer's file lies on this machine; only the driver opens it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed; see ``packing.pack`` for nulls, ties and repeated rows."""
    return digest_pieces(packing.pack(common.documents(spark, folder).select("doc_id", "text"), tokenizer_path(), PACK_WINDOW, PACK_END))


def digest_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


CHAT_SCHEMAS = {
    "ask": {"type": "object", "required": ["prompt", "turn"], "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False},
}


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn that isn't the assistant's is a call of ``ask``; the assistant's next turn is its result.

    A call depends on the call two turns before it.
    """
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    name = lambda shift: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + shift).cast("string"))
    calls = turns.where("role <> 'assistant'").select(
        "conv_id", name(0).alias("call_id"), F.col("turn").alias("position"), F.lit("ask").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"), F.array(name(-2)).alias("after"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", name(-1).alias("call_id"), F.col("text").alias("content"))
    linked = chat.link_tool_calls(calls, results, CHAT_SCHEMAS)
    return linked.select("conv_id", "call_id", "position", "level", "status", "n_results", F.size("errors").cast("long").alias("n_errors"), F.sha2("json", 256).alias("json_sha256"))


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, text, conv_id || '-' || turn AS call_id,
           turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM conversations WHERE role <> 'assistant'),
l AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1)::INTEGER AS level FROM c),
r AS (SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL),
j AS (SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.call_id, r.call_id) AS call_id, l.turn AS position, l.level, l.text, r.content, coalesce(r.n, 0) AS n_results,
      CASE WHEN l.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status
      FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.call_id = r.call_id)
SELECT conv_id, call_id, position, level, status, n_results, CASE WHEN status <> 'orphan' AND coalesce(text, '') = '' THEN 1 ELSE 0 END::BIGINT AS n_errors,
       sha256('{' || CASE WHEN status = 'orphan' THEN '' ELSE '"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || to_json(text)::VARCHAR || ',' END || '"turn":' || position || '},' END
       || '"call_id":' || to_json(call_id)::VARCHAR || ',"level":' || coalesce(level::VARCHAR, 'null') || ',"name":' || CASE WHEN status = 'orphan' THEN 'null' ELSE '"ask"' END
       || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}') AS json_sha256
FROM j
"""


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Documents judged by rules whose cutoffs are learned from the labels by language, each labelled text counted once."""
    docs = common.documents(spark, folder).select("doc_id", "lang", "text", F.md5(F.coalesce("text", F.lit(""))).alias("same"))
    metrics = common.materialise(quality.with_metrics(docs).drop("text"), "metrics")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    cutoffs = quality.learn(metrics, labels, "lang", text_key="same")
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(metrics, cutoffs, "lang").select(*own)


def _op3_sql() -> str:
    grid = ", ".join(f"('{rule}', {i}, {cut}::DOUBLE)" for rule, cuts in quality.SOFT_RULES.items() for i, cut in enumerate(cuts))
    rules, each = len(quality.SOFT_RULES), quality.RISK / len(quality.SOFT_RULES)
    return rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS_SQL} AS ws,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT place) AS n FROM rep GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, md5(t) AS same, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_share,
      n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share FROM m),
x AS (SELECT doc_id, lang, same, rule, share FROM (SELECT doc_id, lang, same, symbol_share, dup_line_share, repeat_share FROM b) UNPIVOT (share FOR rule IN (symbol_share, dup_line_share, repeat_share))),
good AS (SELECT x.lang, x.rule, x.same, x.share FROM x JOIN b USING (doc_id) JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed GROUP BY ALL HAVING min(q) = 1),
grid(rule, step, cutoff) AS (VALUES {grid}),
tests AS (SELECT lang, g.rule, step, cutoff, count(*) AS n, count(*) FILTER (share > cutoff) AS k FROM good JOIN grid g ON g.rule = good.rule GROUP BY ALL),
proof AS (SELECT *, k < n * {each} AND least(1.0, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({each}) + (n - i) * ln(1 - {each})))))
      <= {quality.ERROR} / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM good)) * {rules}) AS proven FROM tests),
upto AS (SELECT *, bool_and(proven) OVER (PARTITION BY lang, rule ORDER BY step) AS ok FROM proof),
cut AS (SELECT lang, rule, arg_max(cutoff, step) AS cutoff FROM upto WHERE ok GROUP BY ALL),
bad AS (SELECT DISTINCT x.doc_id FROM x JOIN cut c ON x.lang IS NOT DISTINCT FROM c.lang AND x.rule = c.rule AND x.share > c.cutoff)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM b LEFT JOIN bad USING (doc_id)
"""


OP3_SQL = _op3_sql()


def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    """All URLs judged; see ``urls.filter_urls`` for nulls, ties and repeated rows."""
    rules = spark.createDataFrame(URL_RULES, urls.RULE_SCHEMA)
    return urls.filter_urls(common.pages(spark, folder).select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH rules(action, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
cut AS (SELECT row_number() OVER () AS id, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
page AS (SELECT id, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hit AS (SELECT p.id, r.host || r.path AS rule, r.action,
        row_number() OVER (PARTITION BY p.id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.action DESC) AS n
        FROM page p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.action, 'allow') AS verdict FROM page p LEFT JOIN hit h ON h.id = p.id AND h.n = 1
"""


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in shards of even bytes, equal texts together (two texts whose hashes collide, too); null texts are
    empty ones.  See ``sharding.assign_shards`` for ties, repeated rows and empty tables."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = common.documents(spark, folder).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("group")
    )
    placed = sharding.assign_shards(common.materialise(rows, "sizes"), SHARDS, "group", "size")
    slots = common.number_within(common.materialise(placed, "placed"), "shard", ["doc_id", "group", "size"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of all documents; see ``mixing.mix`` for nulls, ties and repeated rows."""
    rows = common.documents(spark, folder).select("doc_id", "source", common.count_words(F.col("text")).alias("size"))
    return mixing.mix(rows, MIX_WEIGHTS, MIX_EPOCHS).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS_SQL})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
t AS (SELECT *, 3 * source_size AS lim,
      sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest_weight
      FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT arg_max(rest, rest_weight) AS lrest, max(rest_weight) AS lweight FROM t WHERE rest * weight <= lim * rest_weight),
plan AS (SELECT source, source_size, least(lim::DOUBLE, (weight * lrest)::DOUBLE / lweight::DOUBLE) AS target FROM t, lev),
q AS (SELECT *, floor(target)::BIGINT // greatest(source_size, 1) AS whole, floor(target)::BIGINT - floor(target)::BIGINT // greatest(source_size, 1) * source_size AS rest FROM plan),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.rest,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - upto + size)))::BIGINT AS taken FROM r
"""


REPEAT_WORDS = 50


def op7_substring(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without repeated passages; see ``substring.remove_repeats`` for nulls, ties and repeated rows."""
    return substring.remove_repeats(common.documents(spark, folder).select("doc_id", "text"), REPEAT_WORDS)


OP7_SQL = rf"""
WITH w AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {REPEAT_WORDS - 1}], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {REPEAT_WORDS - 2})) AS i FROM w)),
firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win),
gone AS (SELECT doc_id, list(DISTINCT place) AS places FROM (SELECT doc_id, unnest(range(i, i + {REPEAT_WORDS})) AS place FROM firsts WHERE least < doc_id) GROUP BY doc_id),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.place) AS text, count(word) AS n FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w) w
  LEFT JOIN (SELECT doc_id, unnest(places) AS place, TRUE AS out FROM gone) g ON g.doc_id = w.doc_id AND g.place = w.place WHERE g.out IS NULL GROUP BY w.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""


def op8_exact(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the one of equal text that stays; see ``exact.exact_duplicates`` for nulls and repeated rows."""
    return exact.exact_duplicates(common.documents(spark, folder).select("doc_id", "text"))


OP8_SQL = """
WITH g AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM g WINDOW w AS (PARTITION BY t)
"""


def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages; see ``html.extract_text`` for nulls, empty and broken pages and repeated rows."""
    return html.extract_text(common.pages(spark, folder).select("page_id", "url", "html"))


def op10_near(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their near duplicates; see ``near.near_duplicates`` for nulls, ties and repeated rows."""
    return near.near_duplicates(common.documents(spark, folder).select("doc_id", "text"))


OP10_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS_SQL.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM sets GROUP BY doc_id)),
ones AS (SELECT s.doc_id, s.g, z.n FROM sets s JOIN sizes z USING (doc_id) WHERE doc_id IN (SELECT class FROM classes)),
-- A link shares one of the rarest quarter of its shingles, by (documents that have it, shingle).
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS r FROM (SELECT *, count(*) OVER (PARTITION BY g) AS f FROM ones)),
heads AS (SELECT doc_id, g, n FROM ranked WHERE r <= n - (3 * n + 3) // 4 + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM heads a JOIN heads b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM (SELECT p.a, p.b, na, nb, count(*) AS c FROM pairs p JOIN ones x ON x.doc_id = p.a JOIN ones y ON y.doc_id = p.b AND x.g = y.g GROUP BY ALL) WHERE 100 * c >= 75 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT class AS node, class AS seen FROM classes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen),
least AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(l.component, w.doc_id) AS component_id, coalesce(l.component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sizes z ON z.doc_id = w.doc_id LEFT JOIN classes c ON c.doc_id = w.doc_id LEFT JOIN least l ON l.node = c.class
"""


TOP = 10


def op11_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of each item; see ``ranked.rank`` for nulls, ties and repeated rows."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return ranked.rank(common.documents(spark, folder).select("doc_id", "text"), items, TOP)


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), items AS (SELECT row_number() OVER () AS iid, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
d AS (SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM docs),
q AS (SELECT DISTINCT iid, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
n AS (SELECT count(*) AS docs, coalesce(sum(len(ts)), 0)::BIGINT AS total FROM d WHERE len(ts) > 0),
m AS (SELECT rid, doc_id, 100 - 90 + (90 * len(ts) * n.docs) // n.total AS m FROM d, n WHERE len(ts) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n.docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, n GROUP BY term, n.docs),
s AS (SELECT q.iid, p.rid, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m ON m.rid = p.rid GROUP BY ALL),
r AS (SELECT i.item_id, m.doc_id, s.score, row_number() OVER (PARTITION BY s.iid ORDER BY s.score DESC, m.doc_id ASC NULLS LAST) AS rank FROM s JOIN m ON m.rid = s.rid JOIN items i ON i.iid = s.iid WHERE s.score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def op12_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against all items; see ``decontaminate.find_passages`` for nulls, empty texts and repeated rows."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontaminate.find_passages(common.documents(spark, folder).select("doc_id", "text"), items)
    listed = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed, (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH lower AS (SELECT FALSE AS test, rid AS id, text FROM (SELECT row_number() OVER () AS rid, text FROM documents) UNION ALL
  SELECT TRUE, rid, text FROM (SELECT row_number() OVER () AS rid, text FROM benchmark)),
w AS (SELECT test, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lower),
sizes AS (SELECT DISTINCT least(10, len(ws)) AS k FROM w WHERE test AND len(ws) > 0),
win AS (SELECT test, id, i, k, md5(array_to_string(ws[i:i + k - 1], ' ')) AS g FROM (SELECT test, id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w JOIN sizes ON NOT test OR k = least(10, len(ws)))),
match AS (SELECT DISTINCT d.id, d.i, d.k, t.id AS item FROM win d JOIN win t ON d.k = t.k AND d.g = t.g AND NOT d.test AND t.test),
hits AS (SELECT id, count(DISTINCT place) AS n FROM (SELECT id, unnest(range(i, i + k)) AS place FROM match) GROUP BY id),
named AS (SELECT DISTINCT m.id, coalesce(b.item_id::VARCHAR, '') AS name FROM match m JOIN (SELECT row_number() OVER () AS rid, item_id FROM benchmark) b ON b.rid = m.item),
told AS (SELECT id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM named GROUP BY id)
SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) d JOIN w ON NOT w.test AND w.id = d.rid LEFT JOIN hits h ON h.id = d.rid LEFT JOIN told t ON t.id = d.rid
"""


#: Tolerance of op13, and the multiple to which odd ids' times are floored.
ASOF_TOLERANCE, DAY = 72 * 3_600_000_000, 86_400_000_000


def _moment(number: str, moment: str) -> Column:
    """Microseconds of a time column, floored to days where the CRC of the row's number is odd."""
    us = asof.micros(F.col(moment))
    return F.when(F.pmod(_crc(number), F.lit(2)) == 1, us - F.pmod(us, F.lit(DAY))).otherwise(us)


def _crc(number: str) -> Column:
    return F.crc32(F.col(number).cast("string").cast("binary"))


def op13_asof(spark: SparkSession, folder: str) -> DataFrame:
    """The order that each click follows.

    Of copies that differ, the one with a client and a time counts, then the smallest.  A null number has no CRC and is
    taken as it is; all rows with a null click_id are copies of one.  A total that no number of cents can express is
    null.  See ``asof.asof_join`` for nulls, ties and repeated orders.
    """
    clicks, sales = spark.read.parquet(f"{folder}/clicks.parquet"), spark.read.parquet(f"{folder}/sales.parquet")
    usable = F.struct(F.isnull("client_id").alias("a"), F.isnull("ts").alias("b"), "client_id", "ts")
    one = clicks.groupBy("click_id").agg(F.min(usable).alias("c")).select("click_id", "c.client_id", "c.ts")
    asks = one.select("click_id", "client_id", F.coalesce(_moment("click_id", "ts"), asof.micros(F.col("ts"))).alias("ts_us"))

    cents = F.col("total") * 100 + 0.5
    order = lambda sale, priority: F.struct(sale.alias("sale_id"), priority.alias("priority"))
    first = order(F.col("sale_id"), F.col("priority"))
    both = F.array(first, order(-1 - F.col("sale_id"), 6 - F.col("priority")))
    orders = sales.select(
        "client_id", F.coalesce(_moment("sale_id", "sold_at"), asof.micros(F.col("sold_at"))).alias("ts_us"),
        F.when(F.abs(cents) < 9e18, F.floor(cents)).cast("long").alias("total_cents"),
        F.explode(F.when(F.pmod(_crc("sale_id"), F.lit(3)) != 0, both).otherwise(F.array(first))).alias("o"),
    ).select("client_id", "ts_us", "o.sale_id", "o.priority", "total_cents")
    found = asof.asof_join(asks, orders, "client_id", "ts_us", ASOF_TOLERANCE, [F.col("priority"), F.bitwise_not("sale_id").alias("small")], ["sale_id", "total_cents"])
    lag = F.col("ts_us") - F.col("matched_at")
    return found.select("click_id", "client_id", "ts_us", "sale_id", lag.alias("lag_us"), "total_cents", "n_tied")


OP13_SQL = """
WITH crc(t) AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) FROM range(256) r(i)),
clicked AS (SELECT click_id, client_id, epoch_us(ts) AS us, click_id::VARCHAR AS digits FROM clicks
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY client_id IS NULL, ts IS NULL, client_id, ts) = 1),
sold AS (SELECT sale_id, client_id, priority, total, epoch_us(sold_at) AS us, sale_id::VARCHAR AS digits FROM sales),
ids AS (SELECT DISTINCT digits FROM (SELECT digits FROM clicked UNION ALL SELECT digits FROM sold)),
sums AS (SELECT digits, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(digits, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c // 256))) AS h FROM ids, crc),
asks AS (SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN us - us % 86400000000 ELSE us END AS ts_us FROM clicked LEFT JOIN sums USING (digits)),
known AS (SELECT sale_id, client_id, priority, total, h, CASE WHEN h % 2 = 1 THEN us - us % 86400000000 ELSE us END AS moment FROM sold LEFT JOIN sums USING (digits)),
orders AS (SELECT sale_id, client_id, priority, total, moment FROM known UNION ALL SELECT -1 - sale_id, client_id, 6 - priority, total, moment FROM known WHERE h % 3 <> 0),
near AS (SELECT a.click_id, max(o.moment) AS moment FROM asks a JOIN orders o ON o.client_id = a.client_id AND o.moment BETWEEN a.ts_us - 259200000000 AND a.ts_us GROUP BY a.click_id),
best AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY priority DESC NULLS LAST, sale_id ASC NULLS LAST, total DESC NULLS LAST) AS r FROM orders WINDOW w AS (PARTITION BY client_id, moment))
SELECT a.click_id, a.client_id, a.ts_us, b.sale_id, a.ts_us - n.moment AS lag_us, CASE WHEN isfinite(b.total) THEN floor(100 * b.total + 0.5)::BIGINT END AS total_cents, coalesce(b.n, 0) AS n_tied
FROM asks a LEFT JOIN near n ON n.click_id IS NOT DISTINCT FROM a.click_id LEFT JOIN best b ON b.client_id = a.client_id AND b.moment = n.moment AND b.r = 1
"""


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_chat": op2_chat,
        "op3_quality": op3_quality,
        "op4_urls": op4_urls,
        "op5_sharding": op5_sharding,
        "op6_mixing": op6_mixing,
        "op7_substring": op7_substring,
        "op8_exact": op8_exact,
        "op9_html": op9_html,
        "op10_near": op10_near,
        "op11_ranked": op11_ranked,
        "op12_decontaminate": op12_decontaminate,
        "op13_asof": op13_asof,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": OP2_SQL, "op3_quality": OP3_SQL, "op4_urls": OP4_SQL, "op6_mixing": OP6_SQL, "op7_substring": OP7_SQL, "op8_exact": OP8_SQL, "op10_near": OP10_SQL, "op11_ranked": OP11_SQL, "op12_decontaminate": OP12_SQL, "op13_asof": OP13_SQL}
