"""Registered queries of this subpackage: each applies one operator to its whole table; SQL where it can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenkeel.llm import (
    centroids, chat_format, decontaminate, divergence, embed_dedup, jaccard_join, packing, pii, quality, secret_scan,
    toxicity, url_filter, warc_revisit,
)
from evenkeel.llm.common import table

URL_RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)


def vocabulary() -> str:
    """Path of the byte-level BPE vocabulary; ``BYTE_BPE_JSON`` names another place."""
    given = os.environ.get("BYTE_BPE_JSON")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "rule string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures derived from ``pages``: a full response of every page, and of every page a later not-modified one.

    Entity tag, dates, headers and times follow from md5 of url and html, so some revisits do not match, some have no
    validator, and some come before any full response of their canonical URL.
    """
    pages = table(spark, sf_dir, "pages").withColumns(
        {
            "h": F.conv(F.substring(F.md5("url"), 1, 7), 16, 10).cast("bigint"),
            "tag": F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12),
        }
    )
    base = 1_700_000_000
    h = F.col("h")

    def header(name: str, value) -> F.Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (base + h % 2_000_000).alias("ts"), F.lit(200).alias("status"),
        F.when(h % 7 != 0, F.concat(F.lit('"'), "tag", F.lit('"'))).alias("etag"),
        F.when(h % 3 != 0, F.concat(F.lit("d"), (h % 1000).cast("string"))).alias("last_modified"),
        F.array(header("Content-Type", F.lit("text/html")), header("Date", F.concat(F.lit("t"), (h % 2_000_000).cast("string"))), header("Expires", F.lit("never"))).alias("headers"),
    )
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (base + (h * 13) % 4_000_000).alias("ts"), F.lit(304).alias("status"),
        F.when(h % 5 == 0, F.lit('"other"')).when(h % 11 != 0, F.concat(F.lit('W/"'), "tag", F.lit('"'))).alias("etag"),
        F.when(h % 2 == 0, F.concat(F.lit("d"), (h % 1000).cast("string"))).alias("last_modified"),
        F.array(header("Content-Type", F.lit("ignored")), header("Date", F.concat(F.lit("r"), (h % 4_000_000).cast("string"))), header("Vary", F.lit("accept"))).alias("headers"),
    )
    return full.unionByName(revisit)


def op4_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc_revisit.resolve(captures(spark, sf_dir))
    told = F.array_join(F.array_sort(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"]))), "; ")
    return resolved.withColumn("headers", told)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), special=True)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.transform("leaks", lambda x: x["item_id"])
    return found.select("doc_id", "contaminated", F.size(ids).alias("n_items"), ids.alias("item_ids"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", marked), (-7, 1, "assistant", marked)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat_format.read_back(chat_format.render(chat_format.fold(chat_format.logged(turns))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_url_filter, op3_jaccard_join, op4_warc_revisit, op5_toxicity,
        op6_sum_of_squares_packing, op7_secret_scan, op8_pii, op9_quality, op10_decontamination,
        op11_centroid_clustering, op12_source_divergence, op13_chat_formatting,
    )
}

REACHABLE = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""


def centroid_rounds(k: int = 40, rounds: int = 5) -> str:
    """Assignments ``a0 …`` and centroids ``c0 …`` of each round, squared distances in integers."""
    steps = [f"""
v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, q FROM v QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, v.q, min(struct_pack(d := list_sum(list_transform(list_zip(v.q, c{r}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := c)) AS n
  FROM v, c{r} GROUP BY vec_id, v.q)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT n.c AS c, i, sum(q[i]) AS s, count(*) AS m FROM a{r}, range(1, 65) t(i) GROUP BY ALL),
m{r} AS (SELECT c, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS q FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN m{r} USING (c))""")
    return ",".join(steps)


def term_list(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


SQL = {
    "op1_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{REACHABLE},
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(least.b, vec_id), vec_id) AS component_id,
       coalesce(least(least.b, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN counted ON counted.a = vec_id""",
    "op2_url_filter": """
WITH rules(rule, host_part, path_part, action) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
  ('net/fr/', 'net', '/fr/', 'block')),
parts AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fits AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM parts JOIN rules ON (host = host_part OR suffix(host, '.' || host_part)) AND starts_with(path, path_part)
  GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.host = p.host AND f.path = p.path""",
    "op3_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t
  FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN []
  ELSE list_distinct([array_to_string(t[i:i + least(len(t), 5) - 1], ' ') FOR i IN range(1, greatest(len(t) - 4, 1) + 1)]) END AS s FROM w),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
{REACHABLE}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(least(least.b, doc_id), doc_id) AS component_id
FROM sets LEFT JOIN least ON least.a = doc_id""",
    "op4_warc_revisit": """
WITH p AS (SELECT page_id, url, ('0x' || substr(md5(url), 1, 7))::BIGINT AS h, substr(md5(coalesce(html, '')), 1, 12) AS tag FROM pages),
u AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^(?i:https?)://', '') AS rest FROM p),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
    lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref'))) AS kept FROM u),
c AS (SELECT page_id, h, tag,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canon FROM q),
f AS (SELECT page_id * 2 AS record_id, canon, 1700000000 + h % 2000000 AS ts, CASE WHEN h % 7 <> 0 THEN '"' || tag || '"' END AS tag,
    CASE WHEN h % 3 <> 0 THEN 'd' || (h % 1000) END AS modified, 't' || (h % 2000000) AS date FROM c),
r AS (SELECT page_id * 2 + 1 AS record_id, canon, 1700000000 + (h * 13) % 4000000 AS ts,
    CASE WHEN h % 5 = 0 THEN '"other"' WHEN h % 11 <> 0 THEN '"' || tag || '"' END AS tag,
    CASE WHEN h % 2 = 0 THEN 'd' || (h % 1000) END AS modified, 'r' || (h % 4000000) AS date FROM c),
m AS (SELECT r.record_id, r.canon, r.tag, r.modified, r.date, max(struct_pack(ts := f.ts, id := f.record_id)) AS old
  FROM r LEFT JOIN f ON f.canon = r.canon AND f.ts < r.ts GROUP BY ALL),
j AS (SELECT m.record_id, m.canon, f.record_id AS refers_to, m.date, CASE WHEN f.record_id IS NULL THEN 'no_earlier'
    WHEN m.tag IS NOT NULL AND f.tag IS NOT NULL THEN CASE WHEN m.tag = f.tag THEN 'resolved' ELSE 'changed' END
    WHEN m.modified IS NOT NULL AND f.modified IS NOT NULL THEN CASE WHEN m.modified = f.modified THEN 'resolved' ELSE 'changed' END
    ELSE 'unverified' END AS verdict FROM m LEFT JOIN f ON f.record_id = m.old.id)
SELECT record_id, canon AS canonical_url, refers_to, verdict,
  CASE WHEN verdict = 'resolved' THEN 'content-type: text/html; date: ' || date || '; expires: never; vary: accept' END AS headers FROM j""",
    "op11_centroid_clustering": f"""
WITH {centroid_rounds()}
SELECT vec_id, n.c::INTEGER AS cluster, n.d AS distance, (sum(n.d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia,
  (sum(n.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c5.q, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.c = n.c""",
    "op12_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {term_list("text")} AS t FROM documents),
o AS MATERIALIZED (SELECT r, lang, source, unnest(t) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
f AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER w + 5 * count(*) OVER w)::HUGEINT AS p FROM f WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER w + 5 * count(*) OVER w)::HUGEINT AS q FROM l WINDOW w AS (PARTITION BY lang)),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
told AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM told
QUALIFY part = 'pair' OR rank <= 50""",
    "op13_chat_formatting": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, length(regexp_replace(text, '{chat_format.PLAIN}', '\\1\\2\\\\\\3', 'g')) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4
  ELSE 14 + length(role) + 2 * (length(role) - length(translate(role, '%][<', ''))) END AS long FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, (3 + sum(long))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id""",
}
