"""The registered queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, linefreq, manifest, mixing, neardup, ngramquality, search, secrets, sharding, simhash, tokenfile, toxicity, urlfilter
from .common import read, written

#: Rules of op8: verdict, host, path.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


def op3_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("t1", "t2")


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.apply_rules(read(spark, sf_dir, "documents"))


def op5_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents"), "doc_id", SHARDS, spread="text")


def op6_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # names the shared vocabulary files; no other query needs it

    docs = read(spark, sf_dir, "documents")
    return tokenfile.decode(tokenfile.encode(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op7_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.judge(pages, urlfilter.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramquality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("t1", "t2")


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = manifest.leaf(*columns, F.regexp_replace("text", "\n", ""))
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, tampered)
    found = manifest.manifest(docs, keep={"changed": changed}).withColumn("changed", F.coalesce("changed", "leaf"))
    digest = manifest.proof_digest(F.col("proof")).alias("proof_sha256")
    return manifest.verified(found, "changed").select("doc_id", "leaf", "subroot", "root", digest, "folded_root", "verified")


def op12_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = written(search.index(read(spark, sf_dir, "documents")), "search-index")
    return search.search(made, read(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH d0 AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
         ((('0x' || substr(md5(coalesce('=' || doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint & 1125899906842623)
           + 0.5::double) / 1125899906842624::double AS u
  FROM documents),
d1 AS (
  SELECT doc_id, source, size, u + (row_number() OVER (PARTITION BY source, doc_id, u, size) - 1) * 0.6180339887498949::double AS v FROM d0),
d AS (SELECT doc_id, source, size, v - floor(v) AS u FROM d1),
lev AS (SELECT *, length(bin(size)) AS level FROM d),
s AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (SELECT *, [3.0::double, 1.0::double, 2.0::double][1 + (place % 3)::int] AS weight, 2.0::double * source_size AS cap FROM s),
water AS (
  SELECT *, (1.5::double * sum(source_size) OVER () - coalesce(sum(cap) OVER (
      ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water_level
  FROM w),
f AS (SELECT *, cap <= weight * water_level AS is_full FROM water),
due AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
    weight * (1.5::double * sum(source_size) OVER () - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0))
      / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target
  FROM f),
ls AS (SELECT source, level, sum(size)::bigint AS level_size, 1 + level / 10.0::double AS q FROM lev GROUP BY source, level),
p AS (
  SELECT ls.*, due.source_size, due.target,
    (target - 2.0::double * coalesce(sum(level_size) OVER (
        PARTITION BY ls.source ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(q * level_size) OVER (
        PARTITION BY ls.source ORDER BY level DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS factor
  FROM ls JOIN due ON ls.source IS NOT DISTINCT FROM due.source),
pf AS (SELECT *, target >= 2.0::double * source_size OR coalesce(factor * q >= 2, false) AS is_full FROM p),
plan AS (
  SELECT source, level, level_size, source_size, target, CASE WHEN is_full THEN 2.0::double ELSE greatest(0, least(2.0::double, coalesce(
    (target - 2.0::double * coalesce(sum(CASE WHEN is_full THEN level_size END) OVER (PARTITION BY source), 0))
    / nullif(sum(CASE WHEN NOT is_full THEN q * level_size END) OVER (PARTITION BY source), 0), 0) * q)) END AS m
  FROM pf),
opened AS (SELECT source, max(target) - sum(floor(m) * level_size) AS open FROM plan GROUP BY source),
r AS (
  SELECT lev.doc_id, lev.source, lev.size, plan.source_size, plan.target, floor(m)::bigint AS whole,
    CASE WHEN m - floor(m) > 0 THEN (u / (1 - u)) / ((m - floor(m)) / nullif(1 - (m - floor(m)), 0)) END AS rnk
  FROM lev JOIN plan ON lev.source IS NOT DISTINCT FROM plan.source AND lev.level = plan.level),
c AS (
  SELECT r.*, open, sum(CASE WHEN rnk IS NOT NULL THEN size ELSE 0 END) OVER (
    PARTITION BY r.source ORDER BY rnk NULLS LAST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to
  FROM r JOIN opened ON r.source IS NOT DISTINCT FROM opened.source)
SELECT doc_id, size, source_size, target,
  (whole + CASE WHEN rnk IS NOT NULL AND size > 0 AND 2 * up_to - size <= 2 * open THEN 1 ELSE 0 END)::bigint AS copies,
  ((whole + CASE WHEN rnk IS NOT NULL AND size > 0 AND 2 * up_to - size <= 2 * open THEN 1 ELSE 0 END) * size)::bigint AS taken
FROM c
"""

OP8_SQL = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
j AS (
  SELECT p.*, rule_host || rule_path AS rule, verdict
  FROM p LEFT JOIN rules ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC, rule_host) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j
"""

OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') AS head,
    list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''),
        lambda c: list_transform(range(8), lambda k: ((ascii(c) >> k::int) & 1)::bigint)))),
      lambda crc, b: xor(crc >> 1, CASE WHEN xor(crc & 1, b) = 1 THEN 3988292384 ELSE 0 END)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
      ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS changed
  FROM d),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
inner_tree AS (
  SELECT source, 0 AS level, pos, n, leaf AS hash FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos))
  FROM inner_tree WHERE n > 1 GROUP BY source, level, pos // 3),
subs AS (
  SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM inner_tree WHERE n = 1),
outer_tree AS (
  SELECT 0 AS level, pos, n, subroot AS hash FROM subs
  UNION ALL
  SELECT level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM outer_tree WHERE n > 1 GROUP BY level, pos // 3),
inner_runs AS (
  SELECT source, level, pos,
    coalesce(string_agg(hash, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(hash, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM inner_tree WHERE n > 1 WINDOW r AS (PARTITION BY source, level, pos // 3 ORDER BY pos)),
outer_runs AS (
  SELECT level, pos,
    coalesce(string_agg(hash, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(hash, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM outer_tree WHERE n > 1 WINDOW r AS (PARTITION BY level, pos // 3 ORDER BY pos)),
siblings AS (
  SELECT placed.doc_id, placed.source, placed.pos, level, l, r FROM placed JOIN inner_runs ON placed.source IS NOT DISTINCT FROM inner_runs.source
    AND inner_runs.pos = placed.pos // (3 ** level)::bigint
  UNION ALL
  SELECT placed.doc_id, placed.source, placed.pos, 1000 + level, l, r FROM placed JOIN subs ON placed.source IS NOT DISTINCT FROM subs.source
    JOIN outer_runs ON outer_runs.pos = subs.pos // (3 ** level)::bigint),
proofs AS (
  SELECT source, pos, string_agg(l || r, '' ORDER BY level) AS proof, list({'l': l, 'r': r} ORDER BY level) AS steps FROM siblings GROUP BY source, pos),
folded AS (
  SELECT placed.*, subs.subroot, coalesce(proof, '') AS proof,
    list_reduce(list_prepend({'l': changed, 'r': ''}, coalesce(steps, [])), lambda a, s: {'l': sha256(s.l || a.l || s.r), 'r': ''}).l AS folded_root
  FROM placed JOIN subs ON placed.source IS NOT DISTINCT FROM subs.source
    LEFT JOIN proofs ON placed.source IS NOT DISTINCT FROM proofs.source AND placed.pos = proofs.pos)
SELECT doc_id, leaf, subroot, root.hash AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = root.hash AS verified
FROM folded, (SELECT hash FROM outer_tree WHERE n = 1) AS root
"""

OP13_SQL = r"""
WITH w AS (
  SELECT id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS id, doc_id, text FROM documents)),
tf AS (SELECT id, doc_id, term, count(*) AS tf FROM w GROUP BY id, doc_id, term),
n AS (SELECT id, sum(tf)::bigint AS n FROM tf GROUP BY id),
t AS (SELECT count(*) AS docs, sum(n)::bigint AS words FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
s AS (
  SELECT item_id, id, doc_id, sum(times * floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::bigint AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN n USING (id), t
  GROUP BY item_id, id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::int AS rank, doc_id, score FROM r WHERE rank <= 20
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_pareto_mix,
        op2_minmax_near_dedup,
        op3_template_decontam,
        op4_line_frequency,
        op5_shard_lookup,
        op6_simple8b_tokens,
        op7_ftrl_toxicity,
        op8_url_filter,
        op9_kneser_ney_quality,
        op10_markov_secrets,
        op11_merkle_manifest,
        op12_anchor_simhash,
        op13_ranked_search,
    )
}

SQL: dict[str, str] = {"op1_pareto_mix": OP1_SQL, "op8_url_filter": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op13_ranked_search": OP13_SQL}
