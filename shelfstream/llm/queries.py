"""The operators over the driver's tables, with production parameters and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfstream.llm import (
    decontaminate, exact_dedup, lm_score, mixing, ngram_join, packing, pii, ranked_search, resampling, sharding,
    token_count, toxicity, url_filter,
)
from shelfstream.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link_components(read(spark, folder, "documents"))


@query
def op1_ngram_links(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link_counts(read(spark, folder, "documents"))


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return mixed.drop("row")


@query
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.judge_copies(read(spark, folder, "documents"))


@query
def op4_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score_texts(read(spark, folder, "documents"))


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_overlap(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return decontaminate.digest(found)


@query
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, folder, "pages"))


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(read(spark, folder, "documents").select("doc_id"))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    grammar = toxicity.fit(docs, read(spark, folder, "labels"))
    return toxicity.score_texts(docs, grammar).drop("clauses")


@query
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.personal_data(read(spark, folder, "documents")))


@query
def op10_token_count(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(read(spark, folder, "documents"))


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.list_pieces(packing.pack(read(spark, folder, "documents")))


@query
def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.score(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sql_words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


PLAIN = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def jaccard_sql(documents: str = "documents") -> str:
    """Components over all pairs that share a shingle; blank texts have none."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {sql_words('text', PLAIN)} AS w FROM {documents}),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (
  SELECT DISTINCT a, a AS b FROM l
  UNION
  SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.m, n.doc_id) AS component_id FROM n LEFT JOIN m ON m.a = n.doc_id
"""


def links_sql(documents: str = "documents") -> str:
    """Components, and the number of documents that each links with."""
    return f"""
WITH w AS (SELECT doc_id, {sql_words('text', PLAIN)} AS w FROM {documents}),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL),
l AS (
  SELECT a, count(*) AS k FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c) GROUP BY a)
SELECT j.doc_id, j.n_shingles, j.component_id, coalesce(l.k, 0) AS n_links
FROM ({jaccard_sql(documents)}) j LEFT JOIN l ON l.a = j.doc_id
"""


ORACLES["op1_ngram_jaccard"] = jaccard_sql()
ORACLES["op1_ngram_links"] = links_sql()

ORACLES["op3_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def decontamination_sql(documents: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, {sql_words('text', ALNUM)} AS w FROM {documents}),
i AS (SELECT item_id, {sql_words('text', ALNUM)} AS w FROM benchmark),
k AS (SELECT item_id, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2),
  lambda s: array_to_string(w[s : s + k - 1], ' '))) AS q FROM k),
ks AS (SELECT DISTINCT k FROM q),
c AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS s, w FROM d, ks WHERE len(w) >= k),
h AS (SELECT c.doc_id, c.s, c.k, q.item_id FROM c JOIN q ON q.k = c.k AND array_to_string(c.w[c.s : c.s + c.k - 1], ' ') = q.q),
u AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS x
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(u.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.x, '')) AS items_sha256,
  coalesce(u.n_hit, 0) > 0 AND 20 * coalesce(u.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN u USING (doc_id) LEFT JOIN t USING (doc_id)
"""


ORACLES["op5_decontamination"] = decontamination_sql()

ORACLES["op6_url_filter"] = f"""
WITH p AS (
  SELECT page_id, contains(coalesce(url, ''), '://') AS ok,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', ['h', 'p']) AS u FROM pages),
h AS (SELECT page_id, CASE WHEN ok THEN translate(u.h, '{UPPER}', '{LOWER}') ELSE '' END AS host,
  CASE WHEN ok THEN u.p ELSE '' END AS path FROM p),
r AS (SELECT page_id, host, path, CASE
  WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
  WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
  WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
  WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
  WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule,
  CASE
  WHEN host LIKE '%casino%' THEN 'spam-casino' || CASE WHEN path = '' THEN '-bare' ELSE '' END
  WHEN host LIKE '%bets%' THEN 'spam-bets' || CASE WHEN path = '' THEN '-bare' ELSE '' END
  WHEN host LIKE '%pills%' THEN 'spam-pills' || CASE WHEN path = '' THEN '-bare' ELSE '' END
  WHEN host || path LIKE '%.xxx/%' AND ('.' || host) LIKE '%.xxx' THEN 'adult'
  WHEN path LIKE '%/login%' THEN 'login'
  WHEN path LIKE '%/cart/%' THEN 'cart'
  WHEN host || path LIKE '%.zip' OR ('.' || host || path) LIKE '%.zip' THEN 'archive' END AS pattern FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN pattern END AS matched FROM r
"""


def sql_number(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def sharding_sql(documents: str = "documents", columns: str = "doc_id") -> str:
    """The table is filled claim by claim in SQL, too."""
    shards, slots = sharding.SHARDS, sharding.SLOTS
    return f"""
WITH RECURSIVE q AS MATERIALIZED (
  SELECT i, j, (o + j * k) % {slots} AS slot FROM (
    SELECT i, {sql_number("'offset:' || i")} % {slots} AS o, {sql_number("'skip:' || i")} % {slots - 1} + 1 AS k
    FROM range(0, {shards}) t(i)), range(0, {slots}) u(j)),
s(slot, turn) USING KEY (slot) AS (
  SELECT CAST(min_by(slot, j) AS BIGINT), CAST(0 AS BIGINT) FROM q WHERE i = 0
  UNION ALL
  SELECT min_by(q.slot, q.j), t.turn FROM (SELECT max(turn) + 1 AS turn FROM s) t, q
  WHERE q.i = t.turn % {shards} AND q.slot NOT IN (SELECT slot FROM recurring.s) GROUP BY t.turn),
d AS (SELECT {columns}, {sql_number("coalesce(CAST(doc_id AS VARCHAR), '')")} % {slots} AS slot FROM {documents})
SELECT d.*, CAST(s.turn % {shards} AS INTEGER) AS shard FROM d JOIN s ON s.slot = d.slot
"""


ORACLES["op7_sharding"] = sharding_sql()


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLES["op11_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {sql_words('text', TERM)} AS w FROM documents),
z AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
q AS (SELECT item_id, unnest(list_distinct({sql_words('text', TERM)})) AS t FROM benchmark),
p AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, z),
c AS (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS c
  FROM p JOIN w USING (t), z),
s AS (SELECT item_id, doc_id, CAST(sum(c) AS BIGINT) AS score FROM q JOIN c USING (t) GROUP BY ALL HAVING sum(c) > 0),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
  doc_id, score FROM s)
SELECT * FROM r WHERE rank <= {ranked_search.BEST}
"""


def sql_crc32(text: str) -> str:
    """zlib's crc32 of the UTF-8 bytes, two hex digits at a time."""
    byte = f"list_transform(range(0, length(hex(encode({text}))) // 2), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    step = "xor(x >> 8, k[CAST(xor(x, y) & 255 AS INTEGER) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda x, y: {step}), 4294967295)"


# The table of crc32 by its rule: eight shifts of each byte.
CRC_TABLE = "WITH RECURSIVE e AS (SELECT i AS i, i AS c, 0 AS n FROM range(0, 256) t(i) UNION ALL SELECT i, " \
    "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM e WHERE n < 8), " \
    "k AS (SELECT list(c ORDER BY i) AS k FROM e WHERE n = 8)"

ORACLES["op13_resampling"] = f"""
{CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {sql_words('text', ALNUM)} AS w FROM documents),
v AS (SELECT r, unnest(w) AS t FROM d),
o AS (SELECT unnest({sql_words('text', ALNUM)}) AS t FROM benchmark),
h AS MATERIALIZED (SELECT t, {sql_crc32('t')} % {resampling.BUCKETS} AS b FROM (SELECT t FROM v UNION SELECT t FROM o), k),
s AS (SELECT b, count(*) AS s FROM v JOIN h USING (t) GROUP BY b),
a AS (SELECT b, count(*) AS a FROM o JOIN h USING (t) GROUP BY b),
z AS (SELECT (SELECT count(*) FROM v) AS zs, (SELECT count(*) FROM o) AS za),
g AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(a, 0) + 1.0::DOUBLE) * (zs + {resampling.BUCKETS}.0::DOUBLE)
    / ((coalesce(s, 0) + 1.0::DOUBLE) * (za + {resampling.BUCKETS}.0::DOUBLE)))) AS BIGINT) AS g
  FROM s FULL JOIN a USING (b), z),
m AS (SELECT r, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM v JOIN h USING (t) JOIN g USING (b) GROUP BY r),
x AS (
  SELECT r, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    CAST('0x' || substr(sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN m USING (r)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
n AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM y
  WHERE n_features >= {resampling.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {resampling.PERCENT} * n // 100 THEN place END AS rank
FROM y LEFT JOIN n USING (r)
"""
