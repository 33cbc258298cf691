"""One query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprints, langid, lexical, licenses, mixing, neardup, packing, quality, sharding, substring, toxicity, warc
from .common import documents, labels, remainder

SHARDS = 24


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(documents(spark, sf_dir)).drop("kept_text")


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir), [1.0] * SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, toxicity.fold(labels(spark, sf_dir)))
    return toxicity.score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "copy", "shuffle_key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), size=4, percent=80).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op11_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("intact")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n_docs = lexical.build_index(documents(spark, sf_dir))
    return lexical.search(index, n_docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_best_fit_packing, op2_syncmer_fingerprints, op3_substring_dedup, op4_rendezvous_sharding, op5_toxicity,
        op6_poisson_mixing, op7_language_id, op8_quality_rules, op9_minhash_near_dedup, op10_license_scan, op11_warc_packages, op12_tokenizer_alignment, op13_block_max_wand,
    )
    return {f.__name__: f for f in found}


_WORDS = """w AS (SELECT doc_id, i, ws[i] AS word, len(ws) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)))"""

OP3 = f"""WITH {_WORDS.format(text="coalesce(text, '')")},
    win AS (SELECT *, CASE WHEN i + 49 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS h FROM w),
    low AS (SELECT h, min(doc_id) AS lo FROM win WHERE h IS NOT NULL GROUP BY h),
    m AS (SELECT win.doc_id, i, word, max(CASE WHEN lo < win.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY win.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM win LEFT JOIN low ON win.h = low.h),
    a AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept FROM m GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id"""

_DRAW = "CAST('0x' || substr(md5('mix-1' || CASE WHEN i > 0 THEN '#' || i ELSE '' END || '|' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0"
OP6 = f"""WITH c AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) * 1.0 / count(*) AS x FROM c), r AS (SELECT s, x / n AS rate, greatest(1, ceil(x / n / 16))::INTEGER AS parts FROM c, t),
    d AS (SELECT doc_id, source, text, rate / parts AS part, list_transform(range(0, parts), lambda i: {_DRAW}) AS us FROM documents JOIN r ON coalesce(source, '') = s),
    k AS (SELECT *, list_sum(list_transform(us, lambda u: len(list_filter(range(0, 64), lambda k: u >= list_sum(list_transform(range(0, k + 1), lambda j: exp(-part + j * ln(part) - lgamma(j + 1.0)))))))) AS copies FROM d),
    x AS (SELECT doc_id, source, text, CAST(unnest(range(0, copies::BIGINT)) AS INTEGER) AS copy FROM k)
    SELECT doc_id, source, copy, md5('mix-1|' || doc_id || '|' || copy) AS shuffle_key, sha256(coalesce(text, '')) AS text_sha256 FROM x"""

OP9 = f"""WITH RECURSIVE {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
    sh AS (SELECT DISTINCT doc_id, h FROM (SELECT doc_id, i, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) AS h FROM w) WHERE i + 3 <= n OR (n < 4 AND i = 1)),
    cnt AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM pr JOIN cnt x ON x.doc_id = a JOIN cnt y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT doc_id AS node, doc_id AS root FROM cnt UNION SELECT both_.b, reach.root FROM reach JOIN both_ ON both_.a = reach.node),
    comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
    SELECT d.doc_id, coalesce(cnt.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN cnt ON cnt.doc_id = d.doc_id LEFT JOIN comp ON comp.node = d.doc_id"""


OP11 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages), k AS (SELECT html, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY html)
    SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM p LEFT JOIN k ON p.html = k.html"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13 = f"""WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
    c AS (SELECT count(*) AS all_docs, sum(len(ws))::BIGINT AS all_terms FROM d WHERE len(ws) > 0),
    p AS (SELECT doc_id, len(ws) AS n, term, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS term FROM d) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    w AS (SELECT item_id, term, floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN f USING (term), c),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms))))::BIGINT AS score FROM w JOIN p USING (term), c GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """The others need a tokenizer, xxHash, CRC-32 or a fitted model; tests hold them against plain versions."""
    return {"op3_substring_dedup": OP3, "op6_poisson_mixing": OP6, "op9_minhash_near_dedup": OP9, "op11_warc_packages": OP11, "op13_block_max_wand": OP13}
