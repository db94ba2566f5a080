"""The registered queries of this package and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import language, line_dedup, mixing, near_dedup, packing, quality, repeats, secret_scan, topk, url_filter
from quern.session import table

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(read(spark, sf_dir, "documents"), 3, 85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.filter(docs["doc_id"].isNotNull() & ~language.held_out(docs["doc_id"])))
    out = language.identify(docs, model, ("doc_id",))
    return out.select("doc_id", language.held_out(out["doc_id"]).alias("held_out"), "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"), ("doc_id",))
    number = lambda kind: F.size(F.expr(f"filter(found, x -> x.kind = '{kind}')")).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(secret_scan.joined("x.base"), 256).alias("base_sha256"), secret_scan.joined().alias("spans"))


LISTED_LABELS = ("adult-x", "casino-win", "cheap-pills", "spam-farm")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.verdicts(pages, url_filter.listed_by_label(pages, LISTED_LABELS))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.FEATURES, "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").filter(topk.usable(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.search(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = table(docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("n")), "document-sizes")
    return mixing.mix(sized, size=sized["n"]).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents")).drop("kept_bytes")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), byte_bpe())


QUERIES: dict[str, Query] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_url_filter": op4_url_filter,
    "op5_quality_rules": op5_quality_rules,
    "op6_exact_topk": op6_exact_topk,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_repeats": op9_repeats,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op4_url_filter": r"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS h, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1, 's'), '') AS q
  FROM pages),
low AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, q FROM parts),
keyed AS (
  SELECT page_id, host, path, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN
    concat(regexp_replace(host, '^www\.', ''), regexp_replace(path, '/+$', ''), regexp_replace(regexp_replace(regexp_replace(q, '^\?', '&'), '&utm_[^&]*', '', 'g'), '^&', '?')) END AS key
  FROM low),
listed AS (SELECT DISTINCT key FROM keyed WHERE key IS NOT NULL AND regexp_matches(host, '(^|\.)(adult-x|casino-win|cheap-pills|spam-farm)(\.|$)')),
ruled AS (
  SELECT page_id, host, path, key,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM keyed)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN EXISTS (SELECT 1 FROM listed l WHERE l.key = ruled.key) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    "op1_near_dedup": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
places AS (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 2, 1) + 1)) AS p FROM words WHERE len(t) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(list_slice(t, p, p + 2), ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, sides.b FROM reach JOIN sides ON reach.y = sides.a),
least_of AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least_of ON x = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id""",
    "op7_mixing": r"""
WITH n AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
d AS (SELECT *, md5(concat_ws(chr(31), '17', coalesce('=' || doc_id, '-'), coalesce('=' || source, '-'), '=' || size, '=' || size)) AS h FROM n),
nb AS (SELECT greatest(1, ceil(count(*) / 4096.0))::BIGINT AS n FROM d),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM totals),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lowest AS (SELECT arg_min(level, cap / w) AS level FROM levels WHERE level * w < cap),
targets AS (SELECT source, source_size, CASE WHEN lowest.level IS NULL THEN cap ELSE least(cap, lowest.level * w) END AS target FROM levels, lowest),
dealt AS (SELECT d.*, ('0x' || substr(h, 1, 8))::BIGINT % n AS b, CASE WHEN count(*) OVER (PARTITION BY source, h) > 1 THEN h ELSE '' END AS part FROM d, nb),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY b, part, (1 - 2 * (b % 2)) * size, h) AS k FROM dealt),
rated AS (SELECT doc_id, size, source_size, target, k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r, ('0x' || substr(md5('17/' || coalesce(t.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM ranked JOIN targets t ON ranked.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(k * r + u) - floor((k - 1) * r + u)) * size)::BIGINT AS taken FROM rated""",
    "op6_exact_topk": """
WITH flat AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM flat),
c AS (SELECT vec_id, i, floor(256 * x)::BIGINT AS v FROM e),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, sum(q.v * r.v)::BIGINT AS score
      FROM c q JOIN c r ON q.i = r.i AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
}
