"""The corpus operators' queries: thin contracts over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, extract, fingerprint, langid, lexical, packing, sharding, simhash, tokenfiles, toxicity, urltrust, warc
from .shared import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontam.report(decontam.mark(docs, items))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op5_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrust.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(langid.learning_rows(docs))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_pack, op3_extract, op4_fingerprint, op5_url_trust, op6_simhash, op7_language, op8_shard, op9_warc, op10_token_files, op11_toxicity, op12_search, op13_divergence)}


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window as a list of words, joined with the document's lists of the same length at every place.
_DECONTAMINATE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, w[k : k + n - 1] AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)
),
places AS (
  SELECT r, n, k, w[k : k + n - 1] AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
found AS (SELECT r, n, k, item FROM places JOIN windows USING (n, g)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(digest, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

#: Base32 by 20 bits of the hexadecimal digest at a time.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id, sha1(html) AS x FROM p),
parts AS (SELECT *, [CAST('0x' || substr(x, 5 * k + 1, 5) AS INTEGER) for k in range(8)] AS v FROM firsts)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> s) & 31) + 1, 1) for s in [15, 10, 5, 0]] for n in v]), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM parts
"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_SEARCH = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_TERMS}, []) AS t FROM documents),
totals AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM docs WHERE len(t) > 0),
asked AS (SELECT q, item_id, t, count(*) AS many FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY q, item_id, t),
posted AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY r, doc_id, n, t),
rarity AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(totals.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posted, totals GROUP BY t),
scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(many * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * posted.n * totals.n) // totals.l)))) AS BIGINT) AS score
  FROM asked JOIN rarity USING (t) JOIN posted USING (t), totals GROUP BY q, item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""

_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
),
posted AS (SELECT r, lang, source, t, count(*) AS n FROM (SELECT r, lang, source, unnest(t) AS t FROM docs) GROUP BY r, lang, source, t),
kept AS (SELECT lang, t, CAST(sum(n) AS BIGINT) AS n FROM posted GROUP BY lang, t HAVING count(*) >= 10),
langs AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
own AS (SELECT lang, source, t, CAST(sum(posted.n) AS BIGINT) AS n FROM posted JOIN kept USING (lang, t) GROUP BY lang, source, t),
sums AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM own GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.t, coalesce(o.n, 0) AS n, 1 + (1000000000 * (coalesce(o.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) AS p,
    1 + (1000000000 * (k.n + 2)) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.t = k.t LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
),
met AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met ON met.lang = a.lang AND met.source = a.source AND met.item = b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """The other operators hash, learn, tokenise or iterate beyond DuckDB's SQL; tests hold them against brute force."""
    return {"op1_decontaminate": _DECONTAMINATE, "op9_warc": _WARC, "op12_search": _SEARCH, "op13_divergence": _DIVERGENCE}
