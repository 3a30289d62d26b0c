"""The registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance, langid, mixture, neighbours, pieces, pii, quality, simhash, tokenbin, toxicity, urlrules, warc, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return put


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and a hash of the text decoded from them."""
    found = pieces.encoded(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(pieces.decoded("ids").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and rules, and the line labelling's verdict, for every document."""
    field = quality.train_from(spark, sf_dir)
    return quality.verdicts(table(spark, sf_dir, "documents"), field).withColumnRenamed("id", "doc_id")


@query(r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
kinds(kind, no, pattern, context) AS (VALUES
  ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', '(?i)\b(e-?mail|contact|mailto)\b'),
  ('ip', 2, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', '(?i)\b(ip|host|server|addr(ess)?)\b'),
  ('card', 3, '[0-9](?:[\x20-]?[0-9])+', '(?i)\b(card|visa|credit|debit|karte|carte|tarjeta)\b'),
  ('phone', 4, '\+[0-9][\x20().0-9-]+[0-9]', '(?i)\b(phone|tel|call|mobile|fax)\b'),
  ('iban', 5, '\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[0-9]{1,3})?)\b', '(?i)\b(iban|account|konto|compte|cuenta)\b'),
  ('id_number', 6, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '(?i)\b(ssn|social|id|passport|ausweis|dni)\b')),
parts AS (
  SELECT doc_id, kind, no, context, regexp_extract_all(text, pattern) AS m, string_split_regex(text, pattern) AS b FROM docs, kinds),
rows AS (
  SELECT doc_id, kind, no, context, unnest(m) AS m, unnest(b[1:len(m)]) AS b, unnest(range(len(m))) AS i FROM parts WHERE len(m) > 0),
placed AS (
  SELECT *, sum(length(b) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS finish, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM rows),
judged AS (
  SELECT *, finish - length(m) AS start,
    CASE kind
      WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) <= 255))
      WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(digits)), lambda k:
        CASE WHEN k % 2 = 0 THEN CAST(digits[length(digits) - k] AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(digits[length(digits) - k] AS INTEGER) + 1] END)) % 10 = 0
      WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
      WHEN 'iban' THEN list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(m, 1, 4), ''), lambda c:
        CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda x, y: (CASE WHEN y < 10 THEN x * 10 ELSE x * 100 END + y) % 97) = 1
      WHEN 'id_number' THEN regexp_matches(right(b, 40), context)
      ELSE true END AS good
  FROM placed),
good AS (SELECT doc_id, kind, no, start, kind || ':' || start || ':' || finish AS span FROM judged WHERE good)
SELECT d.doc_id,
  count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(span, ',' ORDER BY no, start) FILTER (no <= 4), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY no, start), '') AS spans
FROM docs d LEFT JOIN good g ON d.doc_id = g.doc_id GROUP BY d.doc_id
""")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.digest(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, octet_length(raw) AS payload_bytes, sha256(raw) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives, as the archives give them back."""
    return warc.read(warc.archive(table(spark, sf_dir, "pages")))


@query("""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (SELECT source, sum(size) AS s FROM sized GROUP BY source),
weighed AS (
  SELECT source, s, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM sources),
ran AS (
  SELECT *, 2 * s / w AS fills_at,
         (1.5 * CAST(sum(s) OVER () AS DOUBLE) - 2 * coalesce(sum(s) OVER before, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW before AS (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, fills_at) AS level FROM ran WHERE level <= fills_at),
goals AS (
  SELECT source, s, least(water.level * w, CAST(2 * s AS DOUBLE)) AS target FROM ran, water),
budgets AS (
  SELECT *, CAST(CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS BIGINT) AS copies FROM goals),
steps AS (
  SELECT source, h, sum(size) AS size FROM sized GROUP BY source, h),
totals AS (
  SELECT source, h, size, sum(size) OVER (PARTITION BY source ORDER BY h) AS total FROM steps),
edge AS (
  SELECT b.source, max(CASE WHEN t.total - (b.target - b.copies * b.s) < (b.target - b.copies * b.s) - (t.total - t.size) THEN h + 1 ELSE h END) AS below
  FROM totals t JOIN budgets b ON t.source IS NOT DISTINCT FROM b.source
  WHERE b.target - b.copies * b.s > 0 AND t.total - t.size <= b.target - b.copies * b.s AND b.target - b.copies * b.s < t.total
  GROUP BY b.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(b.s AS BIGINT) AS source_size, b.target,
       CAST(d.size * (b.copies + CASE WHEN d.h < coalesce(e.below, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN edge e ON d.source IS NOT DISTINCT FROM e.source
""")
def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix by source weights takes of each document."""
    found = mixture.plan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query()
def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of every document, as they give it back."""
    found = tokenbin.read(tokenbin.write(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "start", F.col("count").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


@query()
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components: fingerprints at most two bits apart are linked."""
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex16().alias("fingerprint"), F.col("component").alias("component_id"))


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document from examples that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    index = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.scores(docs, index).withColumnRenamed("id", "doc_id")
    return found.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


@query()
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.knn(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query()
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; trigrams are learnt from a sample of the documents."""
    model = langid.train(table(spark, sf_dir, "documents"))
    return langid.fuse(table(spark, sf_dir, "pages"), model).withColumnRenamed("page", "page_id")


@query(r"""
WITH step AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_of),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
goal AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
each AS (SELECT doc_id, unnest(words) AS word FROM docs),
known AS (SELECT word FROM each UNION SELECT word FROM goal),
bytes AS (
  SELECT word, list_transform(range(octet_length(encode(word))), lambda j: CAST('0x' || substr(hex(encode(word)), CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM known),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, step),
s AS (SELECT bucket, count(*) AS n FROM each JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM goal JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT h.bucket, CAST(floor(1000 * ln(
    CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM each) + 10000) AS DOUBLE) / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM goal) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) h LEFT JOIN s ON s.bucket = h.bucket LEFT JOIN t ON t.bucket = h.bucket),
sums AS (SELECT doc_id, sum(gain) AS total FROM each JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
weighed AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(CASE WHEN len(words) > 0 THEN floor(CAST(total AS DOUBLE) / len(words)) ELSE 0 END AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM docs LEFT JOIN sums USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM weighed),
best AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN CAST(place AS BIGINT) END AS rank
FROM scored LEFT JOIN best ON scored.doc_id = best.doc_id
""")
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, and the rank of those drawn."""
    found = importance.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: Hosts and beginnings of paths whose verdict is given.
SITES = ["@@||org/", "||example.org/es/", "||example.org/en/1", "@@||com/fr/", "||com/de/"]


@query(r"""
WITH cut AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
sites(of, start, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
lines(line, verdict, pattern) AS (VALUES
  ('/wp-login.', 'block', '/wp-login\.'), ('/cgi-bin/', 'block', '/cgi-bin/'), ('/cart/', 'block', '/cart/'), ('/checkout/', 'block', '/checkout/'),
  ('^sessionid=', 'block', '[^A-Za-z0-9_.%-]sessionid='), ('^utm_source=feed^', 'block', '[^A-Za-z0-9_.%-]utm_source=feed([^A-Za-z0-9_.%-]|$)'),
  ('/search?', 'block', '/search\?'), ('/tag/*/page/', 'block', '(?s)/tag/.*/page/'), ('*.exe|', 'block', '\.exe$'), ('*.zip|', 'block', '\.zip$'),
  ('@@/robots.txt|', 'allow', '/robots\.txt$'), ('@@/sitemap*.xml|', 'allow', '(?s)/sitemap.*\.xml$')),
urls AS (SELECT DISTINCT url, host, path FROM cut WHERE url IS NOT NULL),
by_site AS (
  SELECT url, arg_max(of || start, length(of || start)) AS rule, arg_max(verdict, length(of || start)) AS verdict FROM urls, sites
  WHERE (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start) GROUP BY url),
by_line AS (
  SELECT url, first(line ORDER BY verdict, length(line) DESC, line) AS line, min(verdict) AS verdict FROM urls, lines WHERE regexp_matches(url, pattern) GROUP BY url)
SELECT page_id, host, path, rule, coalesce(s.verdict, l.verdict, 'allow') AS verdict, CASE WHEN rule IS NULL THEN line END AS pattern
FROM cut LEFT JOIN by_site s ON cut.url = s.url LEFT JOIN by_line l ON cut.url = l.url
""")
def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the url rules on every page."""
    return urlrules.judge(table(spark, sf_dir, "pages"), [*SITES, *urlrules.PATTERNS]).withColumnRenamed("id", "page_id")


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the 32 leading components of all, with variance one."""
    return whitening.by_component(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
