"""Queries over this package's operators, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import ann, language_model, packing, pivots, sentencepiece, simhash, substring_dedup, token_store, toxicity, url_filter
from grainmill.llm.common import tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op10_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    both = sentencepiece.decode_documents(sentencepiece.encode_documents(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return token_store.read_tokens(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_url_filter, op3_packing, op4_ann, op5_simhash, op6_sentencepiece, op7_toxicity, op8_token_store, op9_language_model, op10_pivot_dedup)}


def split_sql(url: str) -> str:
    """Host and path of a url, after the first ``://``."""
    rest = f"CASE WHEN {url} IS NULL OR position('://' IN {url}) = 0 THEN '' ELSE substr({url}, position('://' IN {url}) + 3) END"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{upper}', '{upper.lower()}') AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"


def op2_sql(rounds: int = 130, damping: float = 0.85) -> str:
    """The same rules, and the same propagation with a common table expression a round, as many as bring changes below 1e-9."""
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = [(t, v, f"(host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')") for t, v in rules]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[k]}'" for f in fits) + " END"
    link = url_filter.LINK.replace("'", "''")
    parts = [
        f"split AS (SELECT page_id, html, {split_sql('url')} FROM pages)",
        f"judged AS (SELECT page_id, html, host, path, {case(0)} AS rule, {case(1)} AS said FROM split)",
        "votes AS (SELECT host, sum(CASE WHEN said = 'allow' THEN 1 ELSE -1 END) AS vote FROM judged WHERE host <> '' AND said IS NOT NULL GROUP BY host)",
        "seeds AS (SELECT host, kind, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS seed FROM (SELECT host, CASE WHEN vote > 0 THEN 'trust' WHEN vote < 0 THEN 'distrust' END AS kind FROM votes) WHERE kind IS NOT NULL)",
        f"links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS l FROM split)",
        f"edges AS (SELECT src, dst, count(*) AS weight FROM (SELECT src, host AS dst FROM (SELECT src, {split_sql('u')} FROM (SELECT src, CASE WHEN starts_with(l, '//') THEN 'http:' || l ELSE l END AS u FROM links))) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst)",
        "both_ways AS (SELECT src, dst, weight, 'trust' AS kind FROM edges UNION ALL SELECT dst, src, weight, 'distrust' FROM edges)",
        "ways AS (SELECT src AS host, kind, dst, weight / sum(weight) OVER (PARTITION BY src, kind) AS part FROM both_ways)",
        "rank_0 AS (SELECT host, kind, seed AS mass FROM seeds)",
    ]
    for k in range(rounds):
        parts.append(f"rank_{k + 1} AS MATERIALIZED (SELECT host, kind, sum(mass) AS mass FROM (SELECT dst AS host, r.kind, {damping} * mass * part AS mass FROM rank_{k} r JOIN ways USING (host, kind) UNION ALL SELECT host, kind, {1 - damping} * seed FROM seeds) GROUP BY host, kind)")
    parts.append(f"bad AS (SELECT host FROM rank_{rounds} GROUP BY host HAVING coalesce(sum(mass) FILTER (kind = 'distrust'), 0) - coalesce(sum(mass) FILTER (kind = 'trust'), 0) > 0)")
    return "WITH " + ", ".join(parts) + " SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"


#: All pairs; the index finds the links that it tells.
OP10 = """WITH RECURSIVE fine AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.95),
reach AS (SELECT a AS id, a AS r FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.id = vec_id"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; the others are tested against brute force and the libraries."""
    return {"op2_url_filter": op2_sql(), "op10_pivot_dedup": OP10}
