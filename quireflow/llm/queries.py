"""The queries that apply the operators of this subpackage to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, pieces, quality, suffix_dedup, token_counts, url_filter, vector_dedup, warc
from ._spark import scratch, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.summary(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Rules of the url filter (fixed values).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path, "page_id", "url", F.col("html"))
    records = warc.read_warc(spark, path)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sampled = pieces.sample(docs, pieces.vocabulary(), k=2, with_ids=False)
    found = [F.col("samples")[name].alias(name) for name in ("n_pieces", "log_p", "perturbed", "log_inclusion", "ids_sha256")]
    return sampled.select("doc_id", "n_units", F.size("samples").alias("n_samples"), *found, "round_trip")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes by the contract, and beside them the words in passages of 50 words that are elsewhere too,
    which are often shorter than 400 bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.dedup(docs).drop("kept")
    words = suffix_dedup.passage_words(docs).select("key", F.col("n_removed").alias("words"))
    return found.join(words, "key", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("words", F.lit(0)).alias("n_passage_words"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every text: a word goes in at a third, twelve
    characters go at the middle, five are replaced near the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))

    def edit(start, end, text):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(text).alias("text"))

    edits = F.array(edit(n / 3, n / 3, " edited"), edit(n / 2, n / 2 + 12, ""), edit(n * 0.9, n * 0.9 + 5, "2024, a"))
    built = token_counts.build(docs).withColumn("edits", edits).withColumn("n_before", F.col("n_tokens"))
    after = token_counts.recount(built)
    return after.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.length("text").cast("long").alias("n_chars_edited"), F.size("leaf_chars").alias("n_leaves"), "n_encoded_chars")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(chat.format_chats(rows))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the quality labels of the ids that pages and labels share."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = url_filter.judge(pages, pages.join(labels, "page_id").select("url", "good"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(quality.sample(docs, table(spark, sf_dir, "labels")))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_pieces": op3_pieces,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_jaccard": op5_jaccard,
    "op6_token_counts": op6_token_counts,
    "op7_chat": op7_chat,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_vector_dedup": op10_vector_dedup,
}

SQL: dict[str, str] = {}

SQL["op1_decontaminate"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), needles AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS k
  FROM item_words, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), widths AS (SELECT DISTINCT n FROM needles),
windows AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM words, widths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), hits AS (SELECT doc_id, windows.n, i, item_id FROM windows JOIN needles USING (n, k)),
hit_words AS (SELECT DISTINCT doc_id, i + j AS at FROM (SELECT DISTINCT doc_id, n, i FROM hits), unnest(range(0, n)) AS t(j)),
hit_counts AS (SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY doc_id),
item_lists AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit_counts USING (doc_id) LEFT JOIN item_lists USING (doc_id)
"""

SQL["op7_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, chr(92), ''))
    + list_sum(list_transform(['<<SYS>>', '<</SYS>>', '[INST]', '[/INST]', '<s>', '</s>', '[ROLE]', '[:]', '[/ROLE]'], lambda c: (length(text) - length(replace(text, c, ''))) // length(c)))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

SQL["op8_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), named AS (
  SELECT DISTINCT host, string_split(host, '.') AS p FROM parts
), two AS (
  SELECT host, p, array_to_string(list_slice(p, greatest(1, len(p) - 1), len(p)), '.') AS last2, p[len(p)] AS last1, array_to_string(list_slice(p, greatest(1, len(p) - 2), len(p)), '.') AS last3 FROM named
), hosts AS (
  SELECT host, CASE WHEN last2 IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') THEN last3 ELSE last2 END AS domain,
         CASE WHEN last2 IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') THEN last2 ELSE last1 END AS suffix FROM two
), c AS (
  SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(quality) AS DOUBLE) AS k
  FROM parts JOIN labels ON page_id = doc_id JOIN hosts USING (host) WHERE quality IS NOT NULL GROUP BY ALL
), d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM c GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
sums AS (
  SELECT 'host' AS lv, sum(n) AS n, sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) AS sq, count(*) AS g FROM c
  UNION ALL SELECT 'domain', sum(n), sum(k) / sum(n), sum(k * k / n) / sum(n), count(*) FROM d
  UNION ALL SELECT 'suffix', sum(n), sum(k) / sum(n), sum(k * k / n) / sum(n), count(*) FROM s
), strengths AS (
  SELECT lv, n, m, CASE WHEN sq - m * m - m * (1 - m) * g / n <= 0 THEN 1000.0
    ELSE least(1000.0, greatest(1.0, (m * (1 - m) - (sq - m * m)) / (sq - m * m - m * (1 - m) * g / n))) END AS strength FROM sums
), st AS (
  SELECT max(m) FILTER (WHERE lv = 'suffix') AS m0, max(strength) FILTER (WHERE lv = 'suffix') AS a, max(strength) FILTER (WHERE lv = 'domain') AS b, max(strength) FILTER (WHERE lv = 'host') AS e FROM strengths
), scored AS (
  SELECT host, (coalesce(c.k, 0) + e * m2) / (coalesce(c.n, 0) + e) AS mean, coalesce(c.n, 0) + e AS w FROM (
    SELECT h.*, st.*, (coalesce(d.k, 0) + b * m1) / (coalesce(d.n, 0) + b) AS m2 FROM (
      SELECT hosts.*, (coalesce(s.k, 0) + a * m0) / (coalesce(s.n, 0) + a) AS m1 FROM hosts LEFT JOIN s USING (suffix), st) h
    LEFT JOIN d ON d.domain = h.domain, st) x LEFT JOIN c USING (host)
), bounds AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (w + 1)) AS bound FROM scored),
rules(action, rule, h, p) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
fitting AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict
FROM parts LEFT JOIN bounds USING (host) LEFT JOIN fitting USING (page_id)
"""

SQL["op5_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS k FROM words, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) USING (doc_id)
"""

SQL["op2_warc"] = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

SQL["op10_vector_dedup"] = r"""
WITH RECURSIVE clean AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM clean a JOIN clean b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) USING (vec_id) LEFT JOIN (SELECT x AS vec_id, min(y) AS low FROM reach GROUP BY x) USING (vec_id)
"""
