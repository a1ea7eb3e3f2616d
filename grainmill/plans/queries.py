"""The library's queries, each over whole tables, next to SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import pii
from grainmill.functions import text as T
from grainmill.functions.hashing import PRIME, lsh_parameters, permutations
from grainmill.operators import dedup, intervals, ledger, metrics, validate
from grainmill.plans.shared import materialise, spread
from grainmill.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars"))


# SQL that several queries share

W = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pM\pN_]+'), lambda x: x <> '')"
NORMAL = r"trim(regexp_replace(lower(coalesce(text, '')), '[\s\v\x{85}\p{Z}]+', ' ', 'g'))"
DIGEST = f"sha256({NORMAL})"
EXACT = f"exact AS (SELECT doc_id AS id, {DIGEST} AS digest, min(doc_id) OVER (PARTITION BY {DIGEST}) AS keeper FROM documents)"


def grams_sql(n: int, least: int, name: str = "grams", source: str = "documents", key: str = "doc_id") -> str:
    runs = f"list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"
    return f"{name} AS (SELECT id, unnest(list_distinct(CASE WHEN len(w) < {max(least, 1)} THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE {runs} END)) AS g FROM (SELECT {key} AS id, {W} AS w FROM {source}))"


def signature_sql(count: int, name: str = "sig", grams: str = "grams") -> str:
    values = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(permutations(count)))
    least = f"SELECT id, k, min((h * a + b) % {PRIME}) AS m FROM (SELECT id, ('0x' || substr(md5(g), 1, 15))::BIGINT % {PRIME} AS h FROM {grams}), (VALUES {values}) AS p(k, a, b) GROUP BY id, k"
    return f"{name} AS MATERIALIZED (SELECT id, list(m ORDER BY k) AS s FROM ({least}) GROUP BY id)"


def bands_sql(threshold: float, count: int, name: str = "banded", sig: str = "sig") -> str:
    bands, rows = lsh_parameters(threshold, count)
    return f"{name} AS (SELECT id, b, md5(array_to_string(s[b * {rows} + 1:b * {rows} + {rows}], ',')) AS v FROM {sig}, range({bands}) AS r(b))"


SIMILAR = """similar_pairs AS MATERIALIZED (SELECT a, b, n / (x.c + y.c - n) AS similarity FROM (
  SELECT a, b, count(q.g) AS n FROM pairs JOIN grams p ON p.id = a LEFT JOIN grams q ON q.id = b AND q.g = p.g GROUP BY a, b)
  JOIN (SELECT id, count(*) AS c FROM grams GROUP BY id) x ON x.id = a JOIN (SELECT id, count(*) AS c FROM grams GROUP BY id) y ON y.id = b)"""
CLASSES = "classes AS (SELECT id, min(id) OVER (PARTITION BY s) AS class FROM sig)"
REP_PAIRS = "pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM banded x JOIN banded y USING (b, v) JOIN classes c ON c.id = x.id AND c.class = c.id JOIN classes d ON d.id = y.id AND d.class = d.id WHERE x.id < y.id)"


def reach_sql(edges: str, name: str = "comp") -> str:
    """Components of edges(a, b): (id, cluster)."""
    return f"{name}_sym AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}), {name}_reach AS (SELECT a AS id, a AS r FROM {name}_sym UNION SELECT x.id, s.b FROM {name}_reach x JOIN {name}_sym s ON s.a = x.r), {name} AS (SELECT id, min(r) AS cluster FROM {name}_reach GROUP BY id)"


MINHASH = f"{grams_sql(3, 5)}, {signature_sql(128)}, {bands_sql(0.8, 128)}"
BUCKETS = "star AS (SELECT DISTINCT id AS a, min(id) OVER (PARTITION BY b, v) AS b FROM banded), star_edges AS (SELECT a, b FROM star WHERE a <> b)"

# Exact duplicates


@query(f"WITH {EXACT} SELECT id, digest, keeper, id <> keeper AS duplicate FROM exact")
def exact_dedup_keep_first(spark, sf_dir):
    return dedup.exact_duplicates(docs_of(spark, sf_dir))


@query(f"WITH {EXACT} SELECT keeper AS kept, count(*) AS size, min(id) FILTER (id <> keeper) AS first_member, max(id) AS last_member FROM exact GROUP BY keeper HAVING count(*) > 1")
def exact_dedup_groups(spark, sf_dir):
    return dedup.exact_groups(docs_of(spark, sf_dir))


@query("SELECT doc_id AS id, doc_id <> min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS duplicate FROM documents")
def bloom_style_dedup(spark, sf_dir):
    return dedup.bloom_duplicates(docs_of(spark, sf_dir))


# Scalars


@query(f"SELECT doc_id, len({W}) AS n_tokens, len({W}) >= 5 AS long_enough FROM documents")
def tokenize_counts(spark, sf_dir):
    n = F.size(T.tokens(F.coalesce("text", F.lit(""))))
    return docs_of(spark, sf_dir).select("doc_id", n.alias("n_tokens"), (n >= 5).alias("long_enough"))


@query(f"WITH {grams_sql(3, 5)} SELECT doc_id, count(g) AS n_grams, coalesce(max(g), '') AS last_gram FROM documents LEFT JOIN grams ON id = doc_id GROUP BY doc_id")
def ngram_counts(spark, sf_dir):
    grams = T.shingle_set(F.coalesce("text", F.lit("")), 3, 5)
    return docs_of(spark, sf_dir).select("doc_id", F.size(grams).cast("long").alias("n_grams"), F.coalesce(F.array_max(grams), F.lit("")).alias("last_gram"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''), '^[\s\v\x{85}\p{Z}]+|[\s\v\x{85}\p{Z}]+$', '', 'g')), '\p{Nd}', '0', 'g'), '[\p{P}\p{C}\p{S}]+', '', 'g') AS normalized FROM documents")
def normalize_ccnet(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", T.normalize_web(F.coalesce("text", F.lit(""))).alias("normalized"))


@query("SELECT doc_id, regexp_replace(translate(replace(replace(coalesce(text, ''), '-' || chr(10), ''), chr(10), ' '), '" + T.NEWS_MARKS.replace("'", "''") + r"', ''), '[^\x00-\x7F]', '', 'g') AS cleaned FROM documents")
def news_preprocess(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", T.news_text(F.coalesce("text", F.lit(""))).alias("cleaned"))


@query("SELECT doc_id, md5(t) AS md5, sha1(t) AS sha1, sha256(t) AS sha256, ('0x' || substr(sha1(t), 7, 2) || substr(sha1(t), 5, 2) || substr(sha1(t), 3, 2) || substr(sha1(t), 1, 2))::BIGINT AS sha1_32 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def digests(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return docs_of(spark, sf_dir).select("doc_id", F.md5(t).alias("md5"), F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"), T.little_endian_hash(t, 32).alias("sha1_32"))


@query(r"SELECT o_orderkey, (list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(s, i, 1)::INT ELSE (2 * substr(s, i, 1)::INT) // 10 + (2 * substr(s, i, 1)::INT) % 10 END)) % 10) = 0 AS valid FROM (SELECT o_orderkey, reverse(o_orderkey::VARCHAR) AS s FROM orders)")
def luhn(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.luhn_valid(F.col("o_orderkey").cast("string")).alias("valid"))


@query("SELECT page_id, round(coalesce(sum(-p * log2(p)), 0.0), 6) AS bits FROM (SELECT page_id, c, count(*) / any_value(length(url)) AS p FROM (SELECT page_id, url, unnest(string_split(url, '')) AS c FROM pages) GROUP BY page_id, c) GROUP BY page_id")
def entropy(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.round(T.entropy(F.col("url")), 6).alias("bits"))


@query(f"WITH {grams_sql(3, 1)}, pairs AS (SELECT doc_id AS a, b FROM (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY text, doc_id) AS b FROM documents) WHERE b IS NOT NULL), {SIMILAR} SELECT a, b, round(coalesce(similarity, 0), 6) AS similarity FROM pairs LEFT JOIN similar_pairs USING (a, b)")
def jaccard_pairs(spark, sf_dir):
    """Of each source and language, neighbours in order of their texts."""
    from pyspark.sql import Window

    docs = docs_of(spark, sf_dir)
    order = Window.partitionBy("source", "lang").orderBy(F.asc_nulls_last("text"), "doc_id")
    pairs = docs.select(F.col("doc_id").alias("a"), F.lead("doc_id").over(order).alias("b"), F.col("text").alias("x"), F.lead("text").over(order).alias("y")).where("b is not null")
    return dedup.text_similarities(pairs, both_empty=0.0).select("a", "b", F.round("similarity", 6).alias("similarity"))


# MinHash


def signed_docs(spark, sf_dir) -> DataFrame:
    return materialise(dedup.signatures(docs_of(spark, sf_dir)), "signatures")


@query(f"WITH {grams_sql(3, 5)}, {signature_sql(128)} SELECT id, array_to_string(s, ',') AS signature FROM sig")
def minhash_signatures(spark, sf_dir):
    return dedup.signatures(docs_of(spark, sf_dir)).select("id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query(f"WITH {MINHASH}, {CLASSES}, {REP_PAIRS} SELECT a, b FROM pairs")
def lsh_candidate_pairs(spark, sf_dir):
    return dedup.candidate_pairs(signed_docs(spark, sf_dir))


@query(f"WITH {MINHASH}, {CLASSES}, {REP_PAIRS} SELECT a, b, round(list_sum(list_transform(range(1, 129), lambda k: CASE WHEN x.s[k] = y.s[k] THEN 1 ELSE 0 END)) / 128, 6) AS estimate FROM pairs JOIN sig x ON x.id = a JOIN sig y ON y.id = pairs.b")
def signature_estimate(spark, sf_dir):
    signed = signed_docs(spark, sf_dir)
    x, y = signed.select(F.col("id").alias("a"), F.col("signature").alias("x")), signed.select(F.col("id").alias("b"), F.col("signature").alias("y"))
    return dedup.candidate_pairs(signed).join(x, "a").join(y, "b").select("a", "b", F.round(dedup.estimate(F.col("x"), F.col("y")), 6).alias("estimate"))


@query(f"WITH RECURSIVE {MINHASH}, {BUCKETS}, {reach_sql('star_edges')} SELECT id, cluster FROM comp")
def minhash_clusters(spark, sf_dir):
    return dedup.minhash_clusters(signed_docs(spark, sf_dir))


VERIFIED = f"{MINHASH}, {CLASSES}, {REP_PAIRS}, {SIMILAR}, sure AS (SELECT a, b FROM similar_pairs WHERE similarity >= 0.8), {reach_sql('sure')}, labelled AS (SELECT c.id, coalesce(comp.cluster, c.class) AS cluster FROM classes c LEFT JOIN comp ON comp.id = c.class)"


@query(f"WITH RECURSIVE {VERIFIED} SELECT id, cluster FROM labelled WHERE cluster IN (SELECT cluster FROM labelled GROUP BY cluster HAVING count(*) > 1)")
def minhash_verified_clusters(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return dedup.verified_clusters(docs, signed_docs(spark, sf_dir))


@query(f"WITH RECURSIVE {MINHASH}, {CLASSES}, {REP_PAIRS}, {SIMILAR}, {BUCKETS}, {reach_sql('star_edges', 'before')}, sure AS (SELECT DISTINCT id, cluster FROM (SELECT a AS id FROM similar_pairs WHERE similarity >= 0.8 UNION SELECT b FROM similar_pairs WHERE similarity >= 0.8) JOIN before USING (id)), comp AS (SELECT id, min(id) OVER (PARTITION BY cluster) AS cluster FROM sure), labelled AS (SELECT c.id, coalesce(comp.cluster, c.class) AS cluster FROM classes c LEFT JOIN comp ON comp.id = c.class) SELECT id, cluster FROM labelled WHERE cluster IN (SELECT cluster FROM labelled GROUP BY cluster HAVING count(*) > 1)")
def minhash_component_clusters(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return dedup.verified_clusters(docs, signed_docs(spark, sf_dir), verify="component")


@query(f"WITH RECURSIVE {VERIFIED} SELECT doc_id, source, n_chars FROM documents LEFT JOIN labelled ON id = doc_id WHERE coalesce(cluster, doc_id) = doc_id")
def minhash_dedup_keep(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    assigned = dedup.assign(docs, dedup.verified_clusters(docs, signed_docs(spark, sf_dir)))
    return dedup.keep_representatives(assigned).select("doc_id", "source", "n_chars")


# Bit fingerprints

BIT_SUMS = " | ".join(f"(CASE WHEN 2 * sum((h >> {k}) & 1) > count(*) THEN 1::BIGINT << {k} ELSE 0 END)::BIGINT" for k in range(60))
PRINTS = f"prints AS MATERIALIZED (SELECT id, {BIT_SUMS} AS fingerprint FROM (SELECT id, ('0x' || substr(md5(g), 1, 15))::BIGINT AS h FROM grams) GROUP BY id)"
PRINT_PAIRS = "one AS (SELECT fingerprint, min(id) AS id FROM prints GROUP BY fingerprint), pairs AS (SELECT x.id AS a, y.id AS b, bit_count(xor(x.fingerprint, y.fingerprint))::INT AS distance FROM one x JOIN one y ON x.id < y.id AND bit_count(xor(x.fingerprint, y.fingerprint)) <= 3)"


def printed_docs(spark, sf_dir) -> DataFrame:
    return materialise(dedup.fingerprints(docs_of(spark, sf_dir)), "prints")


@query(f"WITH {grams_sql(3, 5)}, {PRINTS} SELECT id, fingerprint FROM prints")
def simhash_signatures(spark, sf_dir):
    return dedup.fingerprints(docs_of(spark, sf_dir))


@query(f"WITH {grams_sql(3, 5)}, {PRINTS}, {PRINT_PAIRS} SELECT a, b, distance FROM pairs")
def simhash_pairs(spark, sf_dir):
    return dedup.fingerprint_pairs(printed_docs(spark, sf_dir))


PRINT_LABELS = "labelled AS (SELECT p.id, coalesce(comp.cluster, one.id) AS cluster FROM prints p JOIN one USING (fingerprint) LEFT JOIN comp ON comp.id = one.id) SELECT id, cluster FROM labelled WHERE cluster IN (SELECT cluster FROM labelled GROUP BY cluster HAVING count(*) > 1)"


@query(f"WITH RECURSIVE {grams_sql(3, 5)}, {PRINTS}, {PRINT_PAIRS}, {reach_sql('pairs')}, {PRINT_LABELS}")
def simhash_clusters(spark, sf_dir):
    return dedup.fingerprint_clusters(printed_docs(spark, sf_dir))


@query(f"WITH RECURSIVE {grams_sql(3, 5)}, {PRINTS}, {PRINT_PAIRS}, {SIMILAR}, sure AS (SELECT a, b FROM similar_pairs WHERE similarity >= 0.5), {reach_sql('sure')}, {PRINT_LABELS}")
def simhash_verified_clusters(spark, sf_dir):
    return dedup.fingerprint_clusters(printed_docs(spark, sf_dir), docs=docs_of(spark, sf_dir))


# Contamination and keep-first

BENCH = f"bench AS (SELECT min(item_id) AS match, {DIGEST} AS digest FROM benchmark GROUP BY digest)"
EXACT_BAD = f"{BENCH}, bad_exact AS (SELECT doc_id AS id, match, 1.0::DOUBLE AS similarity FROM documents JOIN bench ON bench.digest = {DIGEST})"


def best_sql(threshold: float) -> str:
    """best(id, match, similarity) of documents against benchmark, by bands."""
    return f"""{grams_sql(3, 1, 'dg')}, {grams_sql(3, 1, 'bg', 'benchmark', 'item_id')}, {signature_sql(128, 'ds', 'dg')}, {signature_sql(128, 'bs', 'bg')}, {bands_sql(threshold, 128, 'db', 'ds')}, {bands_sql(threshold, 128, 'bb', 'bs')},
cand AS (SELECT DISTINCT db.id, bb.id AS match FROM db JOIN bb USING (b, v)),
scored AS (SELECT c.id, c.match, count(q.g) / (any_value(x.c) + any_value(y.c) - count(q.g)) AS similarity FROM cand c JOIN dg p ON p.id = c.id LEFT JOIN bg q ON q.id = c.match AND q.g = p.g JOIN (SELECT id, count(*) AS c FROM dg GROUP BY id) x ON x.id = c.id JOIN (SELECT id, count(*) AS c FROM bg GROUP BY id) y ON y.id = c.match GROUP BY c.id, c.match),
best AS (SELECT id, match, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, match) AS n FROM scored WHERE similarity >= {threshold}) WHERE n = 1)"""


BAD = f"{EXACT_BAD}, {best_sql(0.2)}, bad AS (SELECT id, match, similarity FROM bad_exact UNION ALL SELECT id, match, similarity FROM best WHERE id NOT IN (SELECT id FROM bad_exact))"


FIRST_LINE = "split_part(coalesce(text, ''), chr(10), 1)"


@query(f"WITH lines AS (SELECT doc_id, {FIRST_LINE} AS text FROM documents), named AS (SELECT doc_id, {DIGEST} AS digest FROM lines), held AS (SELECT min(doc_id) AS match, digest FROM named WHERE doc_id % 7 = 0 GROUP BY digest) SELECT doc_id AS id, match FROM named JOIN held USING (digest)")
def decontaminate_exact_lines(spark, sf_dir):
    """First lines of documents against those of a seventh of them, taken as the reference."""
    rows = docs_of(spark, sf_dir).select("doc_id", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("text"))
    named = materialise(dedup.id_text(rows).select("id", T.content_hash(T.normalize(F.col("text"))).alias("digest")), "lines")
    held = named.where("id % 7 = 0").groupBy("digest").agg(F.min("id").alias("match"))
    return named.join(held, "digest").select("id", "match")


@query(f"WITH {EXACT_BAD} SELECT id, match FROM bad_exact")
def decontaminate_exact(spark, sf_dir):
    docs, bench = docs_of(spark, sf_dir), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    x = dedup.id_text(docs).select("id", T.content_hash(T.normalize(F.col("text"))).alias("digest"))
    y = dedup.id_text(bench).groupBy(T.content_hash(T.normalize(F.col("text"))).alias("digest")).agg(F.min("id").alias("match"))
    return x.join(y, "digest").select("id", "match")


@query(f"WITH {BAD} SELECT id, match, round(similarity, 6) AS similarity FROM bad")
def decontaminate_near(spark, sf_dir):
    found = dedup.contaminated(docs_of(spark, sf_dir), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"), 0.2)
    return found.select("id", "match", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {grams_sql(3, 1, 'dg')}, {grams_sql(3, 1, 'bg', 'benchmark', 'item_id')}, sizes AS (SELECT id, count(*) AS c FROM bg GROUP BY id) SELECT dg.id, bg.id AS match, round(count(*) / any_value(c), 6) AS share FROM dg JOIN bg USING (g) JOIN sizes ON sizes.id = bg.id GROUP BY dg.id, bg.id HAVING count(*) / any_value(c) >= 0.8")
def decontaminate_containment(spark, sf_dir):
    found = dedup.contained(docs_of(spark, sf_dir), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))
    return found.select("id", "match", F.round("share", 6).alias("share"))


@query(f"WITH {best_sql(0.1)} SELECT id, match, round(similarity, 6) AS similarity FROM best")
def near_best_match(spark, sf_dir):
    found = dedup.best_matches(docs_of(spark, sf_dir), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"), 0.1)
    return found.select("id", "match", F.round("similarity", 6).alias("similarity"))


DECIDED = f"""{BAD}, clean AS (SELECT doc_id, text, {DIGEST} AS digest FROM documents WHERE doc_id NOT IN (SELECT id FROM bad)),
firsts AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY digest) AS first FROM clean), reps AS (SELECT doc_id, text FROM clean JOIN firsts ON id = doc_id WHERE id = first),
{grams_sql(3, 1, 'grams', 'reps')}, {signature_sql(128)}, {bands_sql(0.8, 128)}, pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM banded x JOIN banded y USING (b, v) WHERE x.id < y.id), {SIMILAR},
edges AS (SELECT a, b, similarity FROM similar_pairs WHERE similarity >= 0.8), ordered AS (SELECT row_number() OVER (ORDER BY b) AS k, b, list(a) AS near FROM edges GROUP BY b),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL SELECT o.k, CASE WHEN len(list_filter(o.near, lambda a: NOT list_contains(w.gone, a))) > 0 THEN list_append(w.gone, o.b) ELSE w.gone END FROM walk w JOIN ordered o ON o.k = w.k + 1),
dropped AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1)),
near AS (SELECT b, a, similarity FROM (SELECT b, a, similarity, row_number() OVER (PARTITION BY b ORDER BY similarity DESC, a) AS n FROM edges WHERE a NOT IN (SELECT id FROM dropped)) WHERE n = 1),
decided AS (SELECT id, 'contaminated' AS reason, match, similarity FROM bad UNION ALL SELECT f.id, CASE WHEN d.id IS NOT NULL THEN 'near_duplicate' WHEN f.id <> f.first THEN 'exact_duplicate' ELSE 'kept' END,
  CASE WHEN d.id IS NOT NULL THEN near.a WHEN f.id <> f.first THEN f.first END, CASE WHEN d.id IS NOT NULL THEN near.similarity WHEN f.id <> f.first THEN 1.0 END
  FROM firsts f LEFT JOIN dropped d ON d.id = f.first LEFT JOIN near ON near.b = d.id)"""


def decided(spark, sf_dir) -> DataFrame:
    return dedup.decisions(docs_of(spark, sf_dir), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"), 0.8, 0.2)


@query(f"WITH RECURSIVE {DECIDED} SELECT id, reason, match, round(similarity, 6) AS similarity FROM decided")
def pipeline_dedup_decisions(spark, sf_dir):
    return decided(spark, sf_dir).select("id", "reason", "match", F.round("similarity", 6).alias("similarity"))


@query(f"WITH RECURSIVE {DECIDED} SELECT reason, count(*) AS records, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM decided GROUP BY reason")
def dedup_funnel(spark, sf_dir):
    found = materialise(decided(spark, sf_dir), "decided")
    total = found.count()
    return found.groupBy("reason").agg(F.count("*").alias("records"), F.round(F.count("*") / total, 6).alias("share"))


@query(f"WITH RECURSIVE {DECIDED} SELECT match AS kept, count(*) + 1 AS size, min(id) AS first_member, max(id) AS last_member, round(min(similarity), 6) AS least_similarity FROM decided WHERE reason IN ('exact_duplicate', 'near_duplicate') GROUP BY match")
def dedup_star_groups(spark, sf_dir):
    return dedup.star_groups(decided(spark, sf_dir))


# Validation

CONV = "conv AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(text ORDER BY turn) AS c FROM conversations GROUP BY conv_id)"
ORDER = """CASE WHEN list_contains(r[2:], 'system') THEN 'misplaced_system_message' WHEN len(t) = 0 THEN 'no_turns' WHEN t[1] <> 'user' THEN 'first_turn_not_user'
  ELSE coalesce(list_filter(list_transform(range(1, len(t)), lambda i: CASE WHEN t[i + 1] = 'tool' AND t[i] NOT IN ('assistant', 'tool') THEN 'orphan_tool_message' WHEN t[i + 1] = t[i] AND t[i] IN ('user', 'assistant') THEN 'consecutive_same_role' END), lambda x: x IS NOT NULL)[1], CASE WHEN r[-1] <> 'assistant' THEN 'last_turn_not_assistant' END) END"""
CHECKED = f"""{CONV}, turned AS (SELECT conv_id, r, c, CASE WHEN r[1] = 'system' THEN r[2:] ELSE r END AS t FROM conv),
codes AS (SELECT conv_id, list_filter([CASE WHEN len(list_filter(c, lambda x: x IS NULL OR regexp_full_match(x, '[\\s\\v\\x{{85}}\\p{{Z}}]*'))) > 0 THEN 'blank_text' END, CASE WHEN len(r) < 2 THEN 'too_short' END, CASE WHEN len(list_filter(r, lambda x: x IS NULL OR x NOT IN ('system', 'user', 'assistant', 'tool'))) > 0 THEN 'literal_error' END], lambda x: x IS NOT NULL) AS first, {ORDER} AS turn_code FROM turned),
checked AS (SELECT conv_id, CASE WHEN len(first) > 0 THEN list_sort(first) WHEN turn_code IS NOT NULL THEN [turn_code] ELSE [] END AS reasons FROM codes)"""


@query(f"WITH {CHECKED} SELECT conv_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS valid FROM checked")
def validate_turn_order(spark, sf_dir):
    return validate.check_conversations(table(spark, sf_dir, "conversations")).select("conv_id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("valid"))


@query(f"WITH {CHECKED} SELECT reason, count(*) AS records FROM (SELECT unnest(reasons) AS reason FROM checked) GROUP BY reason")
def validate_reason_counts(spark, sf_dir):
    return validate.reason_counts(validate.check_conversations(table(spark, sf_dir, "conversations")))


@query(f"WITH {CHECKED} SELECT count(*) AS total, count(*) FILTER (len(reasons) = 0) AS valid, count(*) FILTER (len(reasons) > 0) AS quarantined, round(count(*) FILTER (len(reasons) > 0) / count(*), 6) AS rate, count(*) FILTER (len(reasons) > 0) / count(*) > 0.5 AS withheld FROM checked")
def validate_funnel(spark, sf_dir):
    return validate.funnel(validate.check_conversations(table(spark, sf_dir, "conversations")), 0.5)


@query(f"WITH {CONV} SELECT conv_id, array_to_string(c[1:-2], chr(10)) AS prompt, c[-1] AS response FROM conv")
def sft_text_fields(spark, sf_dir):
    prompt, response = validate.text_fields(F.col("messages"))
    return validate.conversations(table(spark, sf_dir, "conversations")).select("conv_id", prompt.alias("prompt"), response.alias("response"))


@query("""WITH conv AS (SELECT conv_id, list({'content': text, 'role': role} ORDER BY turn) AS m FROM conversations GROUP BY conv_id) SELECT conv_id, substr(sha256('{"messages":' || to_json(m)::VARCHAR || '}'), 1, 16) AS content_id FROM conv""")
def content_ids(spark, sf_dir):
    return validate.conversations(table(spark, sf_dir, "conversations")).select("conv_id", validate.content_id(F.col("messages")).alias("content_id"))


@query(f"WITH {CONV}, ids AS (SELECT left(md5(c[1]), 2) AS id, conv_id AS line, md5(c[-1]) AS content FROM conv), first AS (SELECT id, min(line) AS first_line, arg_min(content, line) AS first_content FROM ids GROUP BY id) SELECT id, line, first_line, content = first_content AS same_content FROM ids JOIN first USING (id) WHERE line > first_line")
def duplicate_ids(spark, sf_dir):
    """Conversations under a short id made of their first message."""
    contents = F.transform("messages", lambda m: m["content"])
    rows = validate.conversations(table(spark, sf_dir, "conversations")).select(F.left(F.md5(F.element_at(contents, 1)), F.lit(2)).alias("own_id"), F.col("conv_id").alias("at"), F.md5(F.element_at(contents, -1)).alias("content"))
    return validate.duplicate_ids(rows, "own_id", "at", "content")


@query(r"WITH a AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id), s AS (SELECT conv_id, trim(regexp_replace(t[-1], '[\s\v\x{85}\p{Z}]+', ' ', 'g')) AS x, trim(regexp_replace(t[1], '[\s\v\x{85}\p{Z}]+', ' ', 'g')) AS y, length(t[-1]) AS p, length(t[1]) AS q FROM a) SELECT conv_id, coalesce(CASE WHEN x = y THEN 'identical_responses' WHEN p < q THEN 'chosen_scored_below_rejected' END, 'valid') AS code FROM s")
def preference_checks(spark, sf_dir):
    """Pairs of a conversation's last (chosen) and first (rejected) answers, scored by their lengths."""
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("m"))
    chosen, rejected = F.element_at("m", -1)["text"], F.element_at("m", 1)["text"]
    return answers.select("conv_id", F.coalesce(validate.preference_code(chosen, rejected, F.length(chosen), F.length(rejected)), F.lit("valid")).alias("code"))


# Ledger: documents in English and German come first, then all, then all again

FIRST = f"first_batch AS (SELECT doc_id AS line, doc_id::VARCHAR AS record_id, {DIGEST} AS digest FROM documents WHERE lang IN ('en', 'de')), all_batch AS (SELECT doc_id AS line, doc_id::VARCHAR AS record_id, {DIGEST} AS digest FROM documents), seen AS (SELECT digest, arg_min(record_id, line) AS seen_id FROM first_batch GROUP BY digest)"
RUN_ROWS = [("run-1", "", "", "first", "bytes-1", "", 1, 0, 0, 0, 0), ("run-2", "", "", "all", "bytes-2", "", 2, 0, 0, 0, 0)]


def ledger_batches(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole table as a batch, the records that the first run leaves, and the runs."""
    digest = T.content_hash(T.normalize(F.coalesce("text", F.lit(""))))
    rows = materialise(docs_of(spark, sf_dir).select(F.col("doc_id").alias("line"), F.col("doc_id").cast("string").alias("record_id"), digest.alias("digest"), "lang"), "batch")
    first = rows.where(F.col("lang").isin("en", "de")).drop("lang")
    records = first.select("digest", "record_id", F.lit("run-1").alias("run_id"), "line", F.lit(1).cast("long").alias("batch"))
    return rows.drop("lang"), records, spark.createDataFrame(RUN_ROWS, ledger.RUNS)


@query(f"WITH {FIRST} SELECT line, record_id, 'new' AS action FROM first_batch")
def ledger_first_batch(spark, sf_dir):
    _, records, runs = ledger_batches(spark, sf_dir)
    batch = records.select("line", "record_id", "digest")
    return ledger.split_batch(batch, records.where("false"), runs, "bytes-1").select("line", "record_id", "action")


@query(f"WITH {FIRST} SELECT line, record_id, CASE WHEN seen_id IS NULL THEN 'new' ELSE 'skipped' END AS action, seen_id FROM all_batch LEFT JOIN seen USING (digest)")
def ledger_second_batch(spark, sf_dir):
    rows, records, runs = ledger_batches(spark, sf_dir)
    return ledger.split_batch(rows, records, runs, "bytes-2").select("line", "record_id", "action", "seen_id")


def second_run(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, records, runs = ledger_batches(spark, sf_dir)
    added = ledger.added_records(ledger.split_batch(rows, records, runs, "bytes-2"), records)
    return rows, records.unionByName(added.select("digest", "record_id", F.lit("run-2").alias("run_id"), "line", F.lit(2).cast("long").alias("batch"))), runs


RECORDS_SQL = f"{FIRST}, records AS (SELECT digest, record_id, line, 'bytes-1' AS source FROM first_batch UNION ALL SELECT digest, record_id, line, 'bytes-2' FROM all_batch WHERE digest NOT IN (SELECT digest FROM first_batch))"


@query(f"WITH {RECORDS_SQL}, known AS (SELECT digest, arg_min(record_id, (source, line)) AS seen_id, arg_min(source, (source, line)) AS source FROM records GROUP BY digest) SELECT line, record_id, CASE WHEN source = 'bytes-2' THEN 'rerun' ELSE 'skipped' END AS action, seen_id FROM all_batch JOIN known USING (digest)")
def ledger_rerun(spark, sf_dir):
    rows, records, runs = second_run(spark, sf_dir)
    return ledger.split_batch(rows, records, runs, "bytes-2").select("line", "record_id", "action", "seen_id")


@query(f"WITH {RECORDS_SQL} SELECT count(*) AS records, count(DISTINCT digest) AS contents, count(DISTINCT record_id) AS ids, 2::BIGINT AS runs FROM records")
def ledger_stats(spark, sf_dir):
    _, records, runs = second_run(spark, sf_dir)
    return ledger.stats(records, runs)


@query(f"WITH ids AS (SELECT source || '-' || lang AS record_id, {DIGEST} AS digest FROM documents) SELECT record_id, count(DISTINCT digest) AS contents FROM ids GROUP BY record_id HAVING count(DISTINCT digest) > 1")
def ledger_collisions_same_id(spark, sf_dir):
    """With source and language as an id."""
    digest = T.content_hash(T.normalize(F.coalesce("text", F.lit(""))))
    return ledger.id_collisions(docs_of(spark, sf_dir).select(F.concat("source", F.lit("-"), "lang").alias("record_id"), digest.alias("digest")))


@query(f"WITH {RECORDS_SQL} SELECT digest, count(*) AS ids, min(record_id) AS first_id, max(record_id) AS last_id FROM records GROUP BY digest HAVING count(*) > 1")
def ledger_collisions_same_content(spark, sf_dir):
    return ledger.content_collisions(second_run(spark, sf_dir)[1])


# Personal data


@query()
def pii_counts(spark, sf_dir):
    found = pii.scrub_table(docs_of(spark, sf_dir), "doc_id", "text")
    pages = pii.scrub_table(table(spark, sf_dir, "pages"), "page_id", "html")
    both = found.select(F.lit("documents").alias("source"), F.explode("counts")).union(pages.select(F.lit("pages"), F.explode("counts")))
    return both.groupBy("source", F.col("key").alias("kind")).agg(F.count("*").alias("texts"), F.sum("value").alias("spans"))


@query()
def pii_scrub(spark, sf_dir):
    found = pii.scrub_table(docs_of(spark, sf_dir), "doc_id", "text")
    return found.select("id", "scrubbed", F.size("detections").alias("n"), F.array_join(F.transform("detections", lambda d: d["kind"]), ",").alias("kinds"))


# Intervals: spans made of ids and sizes, by source

SPANS = "spans AS (SELECT DISTINCT source AS id, (doc_id * 37) % 1000 AS start, (doc_id * 37) % 1000 + n_chars % 50 + 1 AS stop FROM documents)"
REACHED = "reached AS (SELECT *, max(stop) OVER (PARTITION BY id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans)"


def spans_of(spark, sf_dir) -> DataFrame:
    start = F.col("doc_id") * 37 % 1000
    return docs_of(spark, sf_dir).select(F.col("source").alias("id"), start.alias("start"), (start + F.col("n_chars") % 50 + 1).alias("stop"))


@query(f"WITH {SPANS}, {REACHED}, islands AS (SELECT *, sum(CASE WHEN reach >= start THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY start, stop DESC) AS island FROM reached) SELECT id, min(start) AS start, max(stop) AS stop FROM islands GROUP BY id, island")
def merge_intervals_overlapping(spark, sf_dir):
    return intervals.merge_overlapping(spans_of(spark, sf_dir))


@query(f"WITH {SPANS}, {REACHED} SELECT id, start, stop FROM reached WHERE reach IS NULL OR stop > reach")
def merge_intervals_longest(spark, sf_dir):
    return intervals.merge_longest(spans_of(spark, sf_dir))


OFFSETS = "sized AS (SELECT doc_id AS id, octet_length(encode(coalesce(text, ''))) AS size FROM documents), offsets AS (SELECT id, sum(size) OVER (ORDER BY id) - size AS b, sum(size) OVER (ORDER BY id) AS e FROM sized)"


@query(f"WITH {OFFSETS}, ranges AS (SELECT DISTINCT b + (e - b) // 2 AS x, e + (e - b) // 2 AS y FROM offsets) SELECT DISTINCT id, (greatest(x, b) - b)::BIGINT AS start, (least(y, e) - b)::BIGINT AS stop FROM ranges JOIN offsets ON x < e AND y > b WHERE least(y, e) - greatest(x, b) >= 100")
def restore_ranges(spark, sf_dir):
    """Ranges from each document's middle to half its size beyond its end, clipped to documents."""
    offsets = materialise(intervals.document_offsets(docs_of(spark, sf_dir)), "offsets")
    half = F.floor((F.col("end") - F.col("begin")) / 2)
    ranges = offsets.select((F.col("begin") + half).alias("start"), (F.col("end") + half).alias("stop")).where("start < stop").distinct()
    return intervals.restore(ranges, offsets, least=100)


WINDOWS = "bytes AS (SELECT doc_id AS id, encode(coalesce(text, '')) AS t FROM documents), windows AS (SELECT id, i - 1 AS start, t[i:i + 99] AS w FROM (SELECT id, t, unnest(range(1, octet_length(t) - 98)) AS i FROM bytes)), spans AS (SELECT id, start, start + 100 AS stop FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1))"


@query(f"WITH {WINDOWS}, {REACHED}, islands AS (SELECT *, sum(CASE WHEN reach >= start THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY start, stop DESC) AS island FROM reached) SELECT id, min(start) AS start, max(stop) AS stop FROM islands GROUP BY id, island")
def substring_dedup(spark, sf_dir):
    return intervals.repeated_windows(docs_of(spark, sf_dir))


@query(f"WITH {WINDOWS}, {REACHED}, islands AS (SELECT *, sum(CASE WHEN reach >= start THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY start, stop DESC) AS island FROM reached), cut AS (SELECT id, max(stop) - min(start) AS n FROM islands GROUP BY id, island), total AS (SELECT id, sum(n) AS n FROM cut GROUP BY id) SELECT count(*) AS documents, count(total.id) AS cut_documents, sum(coalesce(n, 0))::BIGINT AS cut_bytes, count(*) FILTER (octet_length(t) > coalesce(n, 0)) AS kept FROM bytes LEFT JOIN total USING (id)")
def substring_dedup_totals(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    spans = intervals.repeated_windows(docs)
    per = spans.groupBy("id").agg(F.sum(F.col("stop") - F.col("start")).alias("n"))
    sizes = docs.select(F.col("doc_id").alias("id"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    both = sizes.join(per, "id", "left")
    return both.agg(F.count("*").alias("documents"), F.count("n").alias("cut_documents"), F.sum(F.coalesce("n", F.lit(0))).alias("cut_bytes"), F.count_if(F.col("size") > F.coalesce("n", F.lit(0))).alias("kept"))


# Reports on exact clusters, metrics of MinHash clusters against them

SIZES = f"{EXACT}, sizes AS (SELECT keeper AS cluster, count(*) AS size FROM exact GROUP BY keeper)"


def labelled_docs(spark, sf_dir) -> DataFrame:
    return dedup.exact_duplicates(docs_of(spark, sf_dir)).select("id", F.col("keeper").alias("cluster"))


@query(f"WITH {SIZES} SELECT sum(size)::BIGINT AS rows, count(*) AS clusters, count(*) FILTER (size = 1) AS singletons, count(*) FILTER (size > 1) AS duplicate_clusters, round(1 - count(*) / sum(size), 6) AS dedup_rate, round(avg(size), 6) AS avg_size, max(size) AS max_size, min(size) AS min_size FROM sizes")
def cluster_summary(spark, sf_dir):
    return metrics.cluster_summary(metrics.cluster_sizes(labelled_docs(spark, sf_dir)))


@query(f"WITH {SIZES} SELECT size, count(*) AS clusters FROM sizes GROUP BY size")
def cluster_size_histogram(spark, sf_dir):
    return metrics.size_histogram(metrics.cluster_sizes(labelled_docs(spark, sf_dir)))


@query(f"WITH {SIZES} SELECT (size - 2) // 5 * 5 + 1 AS above, count(*) AS clusters, sum(size)::BIGINT AS rows, (size - 2) // 5 * 5 + 6 AS up_to FROM sizes WHERE size > 1 GROUP BY (size - 2) // 5")
def cluster_size_bins(spark, sf_dir):
    return metrics.size_bins(metrics.cluster_sizes(labelled_docs(spark, sf_dir)))


@query(f"WITH {SIZES} SELECT DISTINCT size, count(*) OVER (ORDER BY size) AS clusters_up_to FROM sizes")
def cluster_cumulative(spark, sf_dir):
    return metrics.size_cumulative(metrics.cluster_sizes(labelled_docs(spark, sf_dir)))


@query(f"WITH {SIZES} SELECT cluster, size, (row_number() OVER (ORDER BY size DESC, cluster))::INT AS rank FROM sizes ORDER BY size DESC, cluster LIMIT 10")
def cluster_top_n(spark, sf_dir):
    return metrics.top_clusters(metrics.cluster_sizes(labelled_docs(spark, sf_dir)))


@query(f"WITH {SIZES} SELECT keeper AS cluster, id, k, substr(text, 1, 500) AS preview FROM (SELECT *, (row_number() OVER (PARTITION BY keeper ORDER BY id))::INT AS k FROM exact) JOIN sizes ON cluster = keeper JOIN documents ON doc_id = id WHERE k <= 3 AND size > 1")
def cluster_samples(spark, sf_dir):
    return metrics.cluster_samples(labelled_docs(spark, sf_dir), docs_of(spark, sf_dir))


@query(f"WITH {EXACT} SELECT id, keeper AS cluster FROM exact JOIN documents ON doc_id = id WHERE contains(lower(text), 'license') ORDER BY id LIMIT 20")
def cluster_search(spark, sf_dir):
    return metrics.cluster_search(labelled_docs(spark, sf_dir), docs_of(spark, sf_dir), "license")


@query(f"WITH {MINHASH}, {CLASSES}, {REP_PAIRS}, {SIMILAR}, sides AS (SELECT a AS id, similarity FROM similar_pairs UNION ALL SELECT b, similarity FROM similar_pairs), best AS (SELECT id, max(similarity) AS best FROM sides GROUP BY id) SELECT count(*) AS members, round(max(best), 6) AS highest, round(avg(best), 6) AS mean, round(min(best), 6) AS lowest, round(quantile_cont(best, 0.9), 6) AS p90, round(count(*) FILTER (best < 0.8) / count(*), 6) AS false_positive_rate FROM best")
def cluster_similarity_stats(spark, sf_dir):
    return metrics.similarity_stats(dedup.similarities(docs_of(spark, sf_dir), dedup.candidate_pairs(signed_docs(spark, sf_dir)), min_length=5))


def truth_and_predicted(spark, sf_dir) -> DataFrame:
    """``(id, truth, predicted)``: exact and MinHash clusters, a row's own id where it is in none."""
    truth = dedup.exact_duplicates(docs_of(spark, sf_dir)).select("id", F.col("keeper").alias("truth"))
    found = dedup.minhash_clusters(signed_docs(spark, sf_dir))
    return truth.join(found, "id", "left").select("id", "truth", F.coalesce("cluster", "id").alias("predicted"))


BOTH = f"{EXACT}, {MINHASH}, {BUCKETS}, {reach_sql('star_edges')}, both_ AS (SELECT e.id, e.keeper AS truth, coalesce(comp.cluster, e.id) AS predicted FROM exact e LEFT JOIN comp ON comp.id = e.id)"
COUNTS = "cells AS (SELECT truth, predicted, count(*) AS n FROM both_ GROUP BY truth, predicted), per AS (SELECT b.id, c.n - 1 AS hit, t.n - 1 AS true_n, p.n - 1 AS pred_n FROM both_ b JOIN cells c USING (truth, predicted) JOIN (SELECT truth, sum(n) AS n FROM cells GROUP BY truth) t ON t.truth = b.truth JOIN (SELECT predicted, sum(n) AS n FROM cells GROUP BY predicted) p ON p.predicted = b.predicted)"


def pair_counts(both: DataFrame) -> DataFrame:
    """``(id, hit, true_n, pred_n)``: other members shared, of the true cluster, of the predicted one; no pairs are made."""
    cells = both.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    t = cells.groupBy("truth").agg(F.sum("n").alias("t"))
    p = cells.groupBy("predicted").agg(F.sum("n").alias("p"))
    return both.join(cells, ["truth", "predicted"]).join(t, "truth").join(p, "predicted").select("id", (F.col("n") - 1).alias("hit"), (F.col("t") - 1).alias("true_n"), (F.col("p") - 1).alias("pred_n"))


@query(f"WITH RECURSIVE {BOTH}, {COUNTS} SELECT round(avg(CASE WHEN pred_n = 0 THEN 0.0 ELSE hit / pred_n END), 6) AS precision, round(avg(CASE WHEN true_n = 0 THEN 1.0 ELSE hit / true_n END), 6) AS recall FROM per")
def pair_precision_recall(spark, sf_dir):
    per = pair_counts(materialise(truth_and_predicted(spark, sf_dir), "both"))
    precision = F.when(F.col("pred_n") == 0, 0.0).otherwise(F.col("hit") / F.col("pred_n"))
    recall = F.when(F.col("true_n") == 0, 1.0).otherwise(F.col("hit") / F.col("true_n"))
    return per.agg(F.round(F.avg(precision), 6).alias("precision"), F.round(F.avg(recall), 6).alias("recall"))


OUTCOME = "CASE WHEN pred_n = 0 AND true_n = 0 THEN 'TN' WHEN hit = pred_n AND hit = true_n THEN 'TP' WHEN pred_n = 0 THEN 'FN' ELSE 'FP' END"


@query(f"WITH RECURSIVE {BOTH}, {COUNTS}, o AS (SELECT {OUTCOME} AS outcome FROM per), c AS (SELECT count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'TN') AS tn, count(*) FILTER (outcome = 'FN') AS fn FROM o) SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision_dup, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall_dup FROM c")
def classification_counts(spark, sf_dir):
    per = pair_counts(materialise(truth_and_predicted(spark, sf_dir), "both"))
    same = (F.col("hit") == F.col("pred_n")) & (F.col("hit") == F.col("true_n"))
    labelled = per.select(F.when((F.col("pred_n") == 0) & (F.col("true_n") == 0), "TN").when(same, "TP").when(F.col("pred_n") == 0, "FN").otherwise("FP").alias("outcome"))
    out = metrics.classification(labelled)
    return out.select("tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision_dup", "recall_dup")))


@query(f"WITH RECURSIVE {BOTH}, cells AS (SELECT truth, predicted, count(*) AS n FROM both_ GROUP BY truth, predicted), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY truth)) AS r, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY predicted)) AS c, (SELECT sum(n) FROM cells) AS t) SELECT round((x - r * c / (t * (t - 1) / 2)) / ((r + c) / 2 - r * c / (t * (t - 1) / 2)), 6) AS ari FROM s")
def adjusted_rand_index(spark, sf_dir):
    both = materialise(truth_and_predicted(spark, sf_dir), "both")
    return metrics.adjusted_rand(both).select(F.round("ari", 6).alias("ari"))


# Streams


@query(f"WITH {EXACT} SELECT id, digest FROM exact WHERE id = keeper")
def stream_dedup_batch(spark, sf_dir):
    return incremental.delivered_once(spark, sf_dir)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return incremental.windowed_counts(table(spark, sf_dir, "events"))
