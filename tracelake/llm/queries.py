"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, embedding_dedup, language_id, license_scan, line_dedup, lm_score, near_dedup, packing, secrets, spelling, token_files, url_filter, whitening
from tracelake.llm.common import crc_mod, work_path

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = language_id.train(docs, ~held_out)
    predicted = language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return predicted.select("doc_id", "held_out", "lang_pred", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    scored = lm_score.score_texts(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _digest_number(value: Column, salt: str) -> Column:
    """A number below 2^32 that depends on ``value`` alone, the same in other engines."""
    return F.conv(F.substring(F.md5(F.concat(value, F.lit(salt))), 1, 8), 16, 10).cast("long")


def url_list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries derived from the hosts and first path segments of ``pages``."""
    host, segment = url_filter.host_of(F.col("url")), F.element_at(F.split(url_filter.path_of(F.col("url")), "/"), 1)
    hosts = pages.select(host.alias("host")).filter("host is not null").distinct()
    n = {k: _digest_number(F.col("host"), k) for k in ("pick", "since", "until", "again")}
    since = n["since"] % 700
    until = since + 1 + n["until"] % 200
    rows = [("spam", "block", "add", since), ("spam", "block", "remove", until)]
    spam = hosts.filter(n["pick"] % 3 == 0)
    entries = [spam.select(F.lit(a).alias("list"), F.lit(b).alias("effect"), F.col("host").alias("pattern"), F.lit(c).alias("action"), d.alias("day")) for a, b, c, d in rows]
    again = spam.filter(n["again"] % 2 == 0)
    entries.append(again.select(F.lit("spam"), F.lit("block"), "host", F.lit("add"), until + 10 + n["again"] % 100))
    paths = pages.select(F.concat_ws("/", host, segment).alias("host")).filter(host.isNotNull() & (segment != "")).distinct()
    entries.append(paths.filter(n["pick"] % 5 == 0).select(F.lit("trusted"), F.lit("allow"), "host", F.lit("add"), since))
    entries.append(paths.filter(n["pick"] % 5 == 1).select(F.lit("legal"), F.lit("block"), "host", F.lit("add"), until))
    out = entries[0]
    for e in entries[1:]:
        out = out.union(e)
    return out


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day that its id fixes, against dated lists over the hosts and paths of all pages."""
    pages = _table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (_digest_number(F.col("page_id").cast("string"), "day") % 1000).alias("day"))
    return url_filter.judge_captures(captures, url_list_entries(pages)).drop("url")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.judge(found).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-files")
    token_files.write_token_files(
        _table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1, vocabulary_size=49_408
    )
    return token_files.read_token_files(spark, path)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in secrets.KINDS])
    spans = F.transform("spans", lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"]))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"), "n_live", "n_example"
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(_table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    by_component = white.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("component", "of"))
    return by_component.select(
        "vec_id", (F.col("component") + 1).alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"),
        "of.whitened", "of.explained", "identity_error",
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score"
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_url_filter": op4_url_filter,
    "op5_order_minhash": op5_order_minhash,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_files": op8_token_files,
    "op9_secrets": op9_secrets,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_whitening": op11_whitening,
    "op12_license_scan": op12_license_scan,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": r"""
WITH c AS (
  SELECT page_id, url, ('0x' || md5(CAST(page_id AS VARCHAR) || 'day')[1:8])::BIGINT % 1000 AS day,
    nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', '')), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1) AS path
  FROM pages
), names AS (
  SELECT DISTINCT 'host' AS kind, host AS p FROM c WHERE host IS NOT NULL
  UNION SELECT DISTINCT 'path', host || '/' || split_part(path, '/', 1) FROM c WHERE host IS NOT NULL AND split_part(path, '/', 1) <> ''
), n AS (
  SELECT kind, p, ('0x' || md5(p || 'pick')[1:8])::BIGINT AS pick, ('0x' || md5(p || 'since')[1:8])::BIGINT % 700 AS since,
    ('0x' || md5(p || 'since')[1:8])::BIGINT % 700 + 1 + ('0x' || md5(p || 'until')[1:8])::BIGINT % 200 AS until, ('0x' || md5(p || 'again')[1:8])::BIGINT AS again FROM names
), e AS (
  SELECT 'spam' AS list, 'block' AS effect, p, 'add' AS action, since AS day FROM n WHERE kind = 'host' AND pick % 3 = 0
  UNION ALL SELECT 'spam', 'block', p, 'remove', until FROM n WHERE kind = 'host' AND pick % 3 = 0
  UNION ALL SELECT 'spam', 'block', p, 'add', until + 10 + again % 100 FROM n WHERE kind = 'host' AND pick % 3 = 0 AND again % 2 = 0
  UNION ALL SELECT 'trusted', 'allow', p, 'add', since FROM n WHERE kind = 'path' AND pick % 5 = 0
  UNION ALL SELECT 'legal', 'block', p, 'add', until FROM n WHERE kind = 'path' AND pick % 5 = 1
), k AS (SELECT list, p, day, max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) AS removed, min(effect) AS effect FROM e GROUP BY ALL),
turns AS (SELECT * FROM (SELECT *, lag(removed, 1, 1) OVER (PARTITION BY list, p ORDER BY day) AS before FROM k) WHERE removed <> before),
iv AS (SELECT * FROM (SELECT list, effect, p, removed, day AS since, lead(day) OVER (PARTITION BY list, p ORDER BY day) AS until FROM turns) WHERE removed = 0),
active AS (
  SELECT c.page_id, iv.list, iv.effect, iv.p, row_number() OVER (PARTITION BY c.page_id ORDER BY length(iv.p) DESC, iv.effect, iv.list, iv.p) AS rn, count(*) OVER (PARTITION BY c.page_id) AS n
  FROM c JOIN iv ON (c.host = iv.p OR ends_with(c.host, '.' || iv.p) OR (contains(iv.p, '/') AND starts_with(c.host || '/' || regexp_replace(c.path, '/+$', '') || '/', iv.p || '/')))
    AND c.day >= iv.since AND (iv.until IS NULL OR c.day < iv.until)
)
SELECT c.page_id, c.day, CASE WHEN effect IS NULL THEN 'unlisted' WHEN effect = 'allow' THEN 'allowed' ELSE 'blocked' END AS verdict,
  list AS by_list, p AS by_pattern, coalesce(n, 0) AS n_active
FROM c LEFT JOIN active ON c.page_id = active.page_id AND rn = 1
""",
    "op6_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM p),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS (SELECT doc_id, i, dw.size AS size, item FROM dw JOIN p USING (size, win)),
n_hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY 1),
n_items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(n_items.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AND 20 * coalesce(n_hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN n_items USING (doc_id)
""",
    "op7_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))
), firsts AS (SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT doc_id, pos, line, coalesce(doc_id <> first_doc, false) AS dropped FROM lines LEFT JOIN firsts USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op10_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, least(min(b), a) AS m FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(deg.n, 0) AS n_links, coalesce(low.m, vec_id) AS component_id, coalesce(low.m, vec_id) = vec_id AS kept
FROM v LEFT JOIN low ON low.a = vec_id LEFT JOIN deg ON deg.a = vec_id
""",
}
