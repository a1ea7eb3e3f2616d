"""Exact, MinHash and bit-fingerprint duplicates, contamination and keep-first decisions.

All operators take ``docs`` with an id and a text column (``doc_id`` and ``text`` unless named otherwise), order rows by
the id, and ignore other columns. Null texts count as empty. Ids are unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex as re
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions import text as T
from grainmill.functions.hashing import PRIME, lsh_parameters, minhash, portable_hashes
from grainmill.plans.components import connected_components
from grainmill.plans.shared import drop_table, is_marked, marked, materialise


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def exact_duplicates(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """``(id, digest, keeper, duplicate)``: keep the smallest id of each digest (of the normalised text, or of ``key``).

    Digests are written once, grouped with partial aggregation and joined back, so a text with many copies is no window
    of its own and no text is normalised twice.
    """
    rows = materialise(id_text(docs).select("id", T.content_hash(T.normalize(F.col("text")) if key is None else key).alias("digest")), "digests")
    keepers = rows.groupBy("digest").agg(F.min("id").alias("keeper"))
    return rows.join(keepers, "digest").select("id", "digest", "keeper", (F.col("id") != F.col("keeper")).alias("duplicate"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """``(kept, size, first_member, last_member)`` of every text with copies."""
    found = exact_duplicates(docs)
    groups = found.groupBy("keeper").agg(F.count("*").alias("size"), F.min(F.when(F.col("duplicate"), F.col("id"))).alias("first_member"), F.max("id").alias("last_member"))
    return groups.where("size > 1").withColumnRenamed("keeper", "kept")


def bloom_duplicates(docs: DataFrame) -> DataFrame:
    """``(id, duplicate)``: whether the very text stood in a row before; a membership filter without false positives."""
    return exact_duplicates(docs, F.col("text")).select("id", "duplicate")


# Runs of words and MinHash

_WORD = re.compile(r"[\p{L}\p{M}\p{N}_]+")
_ASCII = bytes(b if b > 127 or chr(b).isalnum() or chr(b) == "_" else 32 for b in range(256))


@lru_cache(1 << 16)
def _in_words(char: str) -> bool:
    return _WORD.fullmatch(char) is not None


def words_of(text: str) -> list[bytes]:
    """The words of a lower-cased text in UTF-8."""
    if not text.isascii():
        gone = [c for c in set(text) if c > "\x7f" and not _in_words(c)]
        if len(gone) > 50:
            text = text.translate(dict.fromkeys(map(ord, gone), " "))
        else:
            for c in gone:
                text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass").translate(_ASCII).split()


def runs_of(words: list[bytes], n: int) -> set[bytes]:
    """The distinct runs of n words, or of all if there are fewer."""
    if len(words) < n:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(n)))))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``SLICE`` bytes of texts each, so that what a worker holds is bounded."""
    at = size = 0
    for k, length in enumerate(pc.binary_length(batch.column(column)).to_pylist(), 1):
        size += length or 0
        if size > SLICE:
            yield batch.slice(at, k - at)
            at, size = k, 0
    if at < batch.num_rows:
        yield batch.slice(at)


class KnownGrams:
    """Which runs of words a reference may hold, as a bitmap of bounded size that lets some others through."""

    def __init__(self, sets: DataFrame, threshold: float, sign_all: bool = False):
        n = sets.agg(F.sum("count")).first()[0] or 0
        self.shared = sets.sparkSession.sparkContext.broadcast(marked(sets.select(F.explode("grams").alias("gram")), 8 * n))
        self.threshold, self.sign_all = threshold * (1 - 1e-9), sign_all

    def find(self, hashes: np.ndarray) -> np.ndarray | None:
        """Those of a text, or None where too few are known for that similarity to any text of the reference."""
        bitmap, bits = self.shared.value
        held = hashes[is_marked(bitmap, hashes, bits)]
        return held if len(held) and len(held) >= self.threshold * len(hashes) else None


SLICE = 1 << 21  # characters whose sets a worker holds at once


def gram_sets(docs: DataFrame, n: int = 3, permutations: int = 0, seed: int = 42, fingerprint: bool = False, digest: bool = True, grams: bool = True, known: KnownGrams | None = None, only: Broadcast | None = None) -> DataFrame:
    """``(id, digest, words, count, grams, signature, fingerprint)`` of every row, in one pass over the texts.

    digest is that of the normalised text, words the number of words, count that of distinct runs of n words (of all
    words if there are fewer), grams their 60-bit hashes, ascending. signature has the least permuted hashes, null for no
    words or ``permutations=0``; fingerprint per bit the majority over the grams, ties 0, null unless asked for. Without
    ``digest`` and ``grams`` these are null. With ``known``, grams are only those that a reference may hold, and null
    where they are too few for a match; there the signature is null too, unless ``known.sign_all``. ``only``, a bitmap
    of ids from ``marked``, leaves out rows that aren't in it.
    """
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only is not None:
                bitmap, bits = only.value
                batch = batch.filter(pa.array(is_marked(bitmap, batch.column(0).fill_null(0).to_numpy(), bits)))
            yield from map(sets_of, slices(batch, 2))

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, counts, sets, signed, prints = [], [], [], [], []
        for text in batch.column(2).to_pylist():
            words = words_of(text)
            hashes = portable_hashes(runs_of(words, n))
            held = known.find(hashes) if known else hashes
            sizes.append(len(words))
            counts.append(len(hashes))
            sets.append(np.sort(held) if grams and held is not None else None)
            signed.append(minhash(hashes % PRIME, permutations, seed).astype(np.int32) if permutations and words and (held is not None or known.sign_all) else None)
            prints.append(majority(hashes) if fingerprint else None)
        columns = [pa.array(sizes, pa.int32()), pa.array(counts, pa.int32()), pa.array(sets, longs), pa.array(signed, ints), pa.array(prints, pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "digest", "words", "count", "grams", "signature", "fingerprint"])

    rows = id_text(docs)
    name = T.content_hash(T.normalize(F.col("text"))) if digest else F.lit(None).cast("string")
    rows = rows.select(F.col("id").cast("long").alias("id"), name.alias("digest"), F.lower("text").alias("text"))
    return rows.mapInArrow(run, "id long, digest string, words int, count int, grams array<long>, signature array<int>, fingerprint long")


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def signatures(docs: DataFrame, permutations: int = 128, n: int = 3, min_length: int = 5, seed: int = 42) -> DataFrame:
    """``(id, signature)`` of texts with ``min_length`` words or more, over distinct runs of n words."""
    return gram_sets(docs, n, permutations, seed, digest=False, grams=False).where(F.col("words") >= max(min_length, 1)).select("id", "signature")


def bands(signed: DataFrame, count: int, rows: int) -> DataFrame:
    """``(id, band, value)``: the signature's bands."""
    cut = F.array(*(F.xxhash64(F.slice("signature", b * rows + 1, rows)) for b in range(count)))
    return signed.select("id", F.posexplode(cut).alias("band", "value"))


def signature_classes(signed: DataFrame) -> DataFrame:
    """``(id, class)``: the smallest id with the same signature, so that copies are compared once."""
    key = ["low", "high"]  # 128 bits, wide enough for all pairs of all rows
    keyed = signed.select("id", F.xxhash64("signature").alias("low"), F.xxhash64(F.lit(1), "signature").alias("high"))
    return keyed.join(keyed.groupBy(key).agg(F.min("id").alias("class")), key).select("id", "class")


def candidate_pairs(signed: DataFrame, threshold: float = 0.8, permutations: int = 128, classes: bool = True, most: int = 1024) -> DataFrame:
    """``(a, b)``, a < b: rows with different signatures that share a band, or all rows without ``classes``.

    Of equal signatures the smallest id stands for all. A band value that more than ``most`` rows have is cut into
    blocks of rows, and each pair of blocks is a key of its own in the join.
    """
    count, rows = lsh_parameters(threshold, permutations)
    if classes:
        signed = signed.join(signature_classes(signed).where("id = class").select("id"), "id", "left_semi")
    banded = materialise(bands(signed, count, rows), "bands")
    sizes = banded.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").select("band", "value", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    shared = banded.join(sizes, ["band", "value"]).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = shared.select("id", "band", "value", "own", other.alias("other")).select("id", "band", "value", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    left, right = spread.where("own = i").withColumnRenamed("id", "a"), spread.where("own = j").select(F.col("id").alias("b"), "band", "value", "i", "j")
    pairs = left.join(right, ["band", "value", "i", "j"]).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def minhash_clusters(signed: DataFrame, threshold: float = 0.8, permutations: int = 128) -> DataFrame:
    """``(id, cluster)`` of every row of a cluster of two or more.

    A bucket's rows are tied to its smallest id, which gives the same components as all of its pairs.
    """
    count, rows = lsh_parameters(threshold, permutations)
    banded = bands(signed, count, rows)
    least = banded.groupBy("band", "value").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("band", "value", "least")
    edges = banded.join(least, ["band", "value"]).where("id <> least").select("id", "least")
    return connected_components(edges, "id", "least").select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def similarities(docs: DataFrame, pairs: DataFrame, n: int = 3, min_length: int = 1) -> DataFrame:
    """``(a, b, similarity)`` of pairs of ids, by distinct runs of n words, given by 60-bit hashes.

    Texts of other ids are left out where they are read, by a bitmap of bounded size; texts are not shuffled.
    """
    pairs = materialise(pairs, "pairs")
    wanted = pairs.select(F.col("a").cast("long").alias("id")).union(pairs.select(F.col("b").cast("long"))).distinct()
    only = pairs.sparkSession.sparkContext.broadcast(marked(wanted, wanted.count()))
    sets = materialise(gram_sets(docs, n, digest=False, only=only).select("id", "words", "grams"), "sets")
    return set_similarities(sets, pairs, min_length)


def set_similarities(sets: DataFrame, pairs: DataFrame, min_length: int = 1) -> DataFrame:
    """The same of ``sets(id, words, grams)``."""
    grams = F.when(F.col("words") >= max(min_length, 1), F.col("grams")).otherwise(F.array().cast("array<long>"))
    a, b = sets.select(F.col("id").alias("a"), grams.alias("x")), sets.select(F.col("id").alias("b"), grams.alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", T.jaccard(F.col("x"), F.col("y")).alias("similarity"))


def text_similarities(pairs: DataFrame, n: int = 3, both_empty: float = 1.0) -> DataFrame:
    """``(a, b, similarity)`` of ``pairs(a, b, x, y)`` that come with their texts x and y; ``both_empty`` where neither has words.

    The runs of y are kept for the next pair, where it may be x.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = "", set()
        for batch in batches:
            for piece in slices(batch, 3):
                found = []
                for x, y in zip(piece.column(2), piece.column(3)):
                    x, y = x.as_py(), y.as_py()
                    left = kept if x == last else runs_of(words_of(x), n)
                    last, kept = y, runs_of(words_of(y), n)
                    both = len(left & kept)
                    union = len(left) + len(kept) - both
                    found.append(both / union if union else both_empty)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    lower = lambda c: F.lower(F.coalesce(c, F.lit(""))).alias(c)
    return pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), lower("x"), lower("y")).mapInArrow(run, "a long, b long, similarity double")


def verified_clusters(docs: DataFrame, signed: DataFrame, threshold: float = 0.8, permutations: int = 128, n: int = 3, verify: str = "edges") -> DataFrame:
    """``(id, cluster)`` from candidate pairs whose similarity is ``threshold`` or more.

    ``verify="edges"`` takes the components of those pairs; ``"component"`` keeps all their ids of one unverified
    cluster together, as clustering first and checking then does. Copies of one signature go along with it.
    """
    classes = signature_classes(signed)
    found = similarities(docs, candidate_pairs(signed, threshold, permutations), n).where(F.col("similarity") >= threshold)
    if verify == "edges":
        of = connected_components(found, "a", "b")
    else:
        found = materialise(found, "similar")
        before = minhash_clusters(signed, threshold, permutations)
        sure = found.select(F.col("a").alias("id")).union(found.select("b")).distinct().join(before, "id")
        of = sure.join(sure.groupBy("cluster").agg(F.min("id").alias("component")), "cluster").select(F.col("id").alias("node"), "component")
    labelled = classes.join(of.withColumnRenamed("node", "class"), "class", "left").select("id", F.coalesce("component", "class").alias("cluster"))
    many = labelled.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1").select("cluster")
    return labelled.join(many, "cluster").select("id", "cluster")


def assign(docs: DataFrame, clusters: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``__CLUSTER__`` (its own id if it is in none) and ``__duplicate__``."""
    of = clusters.select(F.col("id").alias("_id"), "cluster")
    out = docs.join(of, docs[id_col] == of["_id"], "left")
    return out.withColumn("__CLUSTER__", F.coalesce("cluster", docs[id_col])).withColumn("__duplicate__", F.col("__CLUSTER__") != docs[id_col]).drop("_id", "cluster")


def keep_representatives(assigned: DataFrame, skip: bool = False) -> DataFrame:
    """Drop duplicates, or only label them."""
    return assigned if skip else assigned.where("not __duplicate__")


def estimate(a: Column, b: Column) -> Column:
    """Similarity as two signatures tell it."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


# Bit fingerprints


def fingerprints(docs: DataFrame, n: int = 3, min_length: int = 5, keep_short: bool = False) -> DataFrame:
    """``(id, fingerprint)``: per bit the majority over distinct runs of n words of 60 bits of their md5; ties are 0.

    Texts of fewer than ``min_length`` words are left out, or have the fingerprint 0 with ``keep_short``.
    """
    sets = gram_sets(docs, n, fingerprint=True, digest=False, grams=False)
    long = F.col("words") >= max(min_length, 1)
    return sets.select("id", F.when(long, F.col("fingerprint")).otherwise(0).alias("fingerprint")) if keep_short else sets.where(long).select("id", "fingerprint")


def fingerprint_pairs(prints: DataFrame, bits: int = 3, buckets: int = 4, width: int = 60) -> DataFrame:
    """``(a, b, distance)`` of the smallest ids of different fingerprints at ``bits`` differing bits or fewer.

    Of ``buckets`` even blocks (more than ``bits``), close ones agree in one at least: a join by block, then a count.
    """
    if buckets <= bits:
        raise ValueError("there must be more buckets than differing bits")
    one = prints.groupBy("fingerprint").agg(F.min("id").alias("id"))
    edge = [width * k // buckets for k in range(buckets + 1)]
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col("fingerprint"), a).bitwiseAND((1 << (b - a)) - 1).alias("part")) for k, (a, b) in enumerate(zip(edge, edge[1:]))))
    cut = one.select("id", "fingerprint", F.explode(blocks).alias("b")).select("id", "fingerprint", "b.block", "b.part")
    right = cut.select(F.col("id").alias("b"), F.col("fingerprint").alias("other"), "block", "part")
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other")))
    pairs = cut.withColumnRenamed("id", "a").join(right, ["block", "part"]).where("a < b").select("a", "b", distance.cast("int").alias("distance"))
    return pairs.where(F.col("distance") <= bits).distinct()


def fingerprint_clusters(prints: DataFrame, bits: int = 3, buckets: int = 4, docs: DataFrame | None = None, similarity: float = 0.5, n: int = 3) -> DataFrame:
    """``(id, cluster)``; with ``docs`` only pairs of that Jaccard similarity count, representatives included."""
    pairs = fingerprint_pairs(prints, bits, buckets)
    if docs is not None:
        pairs = similarities(docs, pairs, n).where(F.col("similarity") >= similarity)
    least = prints.groupBy("fingerprint").agg(F.min("id").alias("class"))
    of = connected_components(pairs, "a", "b").withColumnRenamed("node", "class")
    labelled = prints.join(least, "fingerprint").join(of, "class", "left").select("id", F.coalesce("component", "class").alias("cluster"))
    many = labelled.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1").select("cluster")
    return labelled.join(many, "cluster").select("id", "cluster")


# Matching against a reference, and keep-first


def best_matches(probes: DataFrame, index: DataFrame, threshold: float, permutations: int = 128, n: int = 3) -> DataFrame:
    """``(id, match, similarity)``: the most similar index row of each probe at ``threshold`` or more, ties to the smaller id."""
    index = materialise(gram_sets(index, n, permutations, digest=False), "index")
    probes = gram_sets(probes, n, permutations, digest=False, known=KnownGrams(index, threshold)).where("grams is not null")
    return best_set_matches(materialise(probes, "probes"), index, threshold, permutations)


def best_set_matches(probes: DataFrame, index: DataFrame, threshold: float, permutations: int = 128) -> DataFrame:
    """The same of tables that ``gram_sets`` made; probes need have only the grams that the index may hold."""
    count, rows = lsh_parameters(threshold, permutations)
    left = bands(probes.where("words > 0 and grams is not null"), count, rows)
    right = bands(index.where("words > 0"), count, rows).withColumnRenamed("id", "match")
    pairs = left.join(right, ["band", "value"]).select("id", "match").distinct()
    x, y = probes.select("id", F.col("grams").alias("x"), F.col("count").alias("c")), index.select(F.col("id").alias("match"), F.col("grams").alias("y"), F.col("count").alias("d"))
    both = F.size(F.array_intersect("x", "y"))
    scored = pairs.join(x.where("x is not null"), "id").join(y, "match").select("id", "match", (both / (F.col("c") + F.col("d") - both)).alias("similarity"))
    best = scored.where(F.col("similarity") >= threshold).groupBy("id").agg(F.max(F.struct("similarity", (-F.col("match")).alias("m"))).alias("b"))
    return best.select("id", (-F.col("b.m")).alias("match"), F.col("b.similarity").alias("similarity"))


def contaminated(docs: DataFrame, reference: DataFrame, threshold: float = 0.8, n: int = 3) -> DataFrame:
    """``(id, match, similarity)``: documents that equal a reference text after normalising (1.0), else the best near match."""
    reference = materialise(gram_sets(reference, n, 128), "reference")
    return contaminated_sets(materialise(gram_sets(docs, n, 128, known=KnownGrams(reference, threshold)), "sets"), reference, threshold)


def contaminated_sets(docs: DataFrame, reference: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The same of tables that ``gram_sets`` made."""
    y = reference.groupBy("digest").agg(F.min("id").alias("match"))
    exact = docs.select("id", "digest").join(y, "digest").select("id", "match", F.lit(1.0).alias("similarity"))
    near = best_set_matches(docs, reference, threshold)
    return exact.unionByName(near.join(exact.select("id"), "id", "left_anti"))


def contained(docs: DataFrame, reference: DataFrame, share: float = 0.8, n: int = 3) -> DataFrame:
    """``(id, match, share)``: documents that hold at least that share of a reference text's runs of n words.

    An extension: whole-text similarity misses a long document that holds an evaluation passage.
    """
    y = id_text(reference).select(F.col("id").alias("match"), T.shingle_set(F.col("text"), n).alias("grams"))
    sizes = y.select("match", F.size("grams").alias("size"))
    held = y.select("match", F.explode("grams").alias("gram"))
    x = id_text(docs).select("id", F.explode(T.shingle_set(F.col("text"), n)).alias("gram"))
    counts = x.join(held, "gram").groupBy("id", "match").agg(F.count("*").alias("n")).join(sizes, "match")
    return counts.where(F.col("n") / F.col("size") >= share).select("id", "match", (F.col("n") / F.col("size")).alias("share"))


def keep_first(rows: DataFrame, edges: DataFrame, most_at_once: int = 200_000) -> DataFrame:
    """``(id, kept)``: in order of id, a row is kept if no kept row before it is its neighbour.

    ``rows(id)`` and ``edges(a, b)``, a < b. Up to ``most_at_once`` edges are decided by one task, in order. With more, a
    row is decided once one of its earlier neighbours is kept (it is dropped) or all of them are dropped (it is kept),
    in rounds until few edges are open. Rows without earlier neighbours are kept at once, so only rows of the edges
    take part.
    """
    edges = materialise(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "edges")
    later = edges.select(F.col("b").alias("id")).distinct()
    state = materialise(later.select("id", F.lit(None).cast("boolean").alias("kept")), "state")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, bool] = {}
        fixed: dict[int, bool] = {}
        for batch in batches:
            for b, own, a, theirs in zip(*(c.to_pylist() for c in batch.columns)):
                if own is not None:
                    fixed[b] = own
                else:
                    kept[b] = kept.get(b, True) and not (kept.get(a, True) if theirs is None else theirs)
        yield pa.RecordBatch.from_arrays([pa.array(list(fixed | kept), pa.int64()), pa.array(list((fixed | kept).values()), pa.bool_())], ["id", "kept"])

    while True:
        open_ = state.where("kept is null")
        told = edges.join(open_.select(F.col("id").alias("b")), "b", "left_semi").join(state.select(F.col("id").alias("a"), F.col("kept").alias("theirs"), F.lit(True).alias("listed")), "a", "left")
        told = told.select("b", F.lit(None).cast("boolean").alias("own"), "a", F.when(F.col("listed").isNull(), True).otherwise(F.col("theirs")).alias("theirs"))
        n = told.count()
        if n <= most_at_once:
            ended = told.coalesce(1).sortWithinPartitions("b", "a").mapInArrow(finish, "id long, kept boolean") if n else open_
            following = materialise(state.where("kept is not null").unionByName(ended), "state")
            drop_table(state)
            state = following
            break
        seen = told.groupBy("b").agg(F.max(F.coalesce(F.col("theirs"), F.lit(False))).alias("any_kept"), F.max(F.col("theirs").isNull()).alias("open"))
        following = state.join(seen, state["id"] == seen["b"], "left").select("id", F.coalesce("kept", F.when(F.col("any_kept"), False).when(~F.col("open"), True)).alias("kept"))
        following = materialise(following, "state")
        drop_table(state)
        state = following
    return rows.join(state, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))


def decisions(docs: DataFrame, reference: DataFrame, threshold: float = 0.8, reference_threshold: float = 0.8, n: int = 3, permutations: int = 128, seed: int = 42, near: bool = True) -> DataFrame:
    """``(id, reason, match, similarity)`` for every document: contaminated, exact_duplicate, near_duplicate or kept.

    Documents are compared with kept ones before them. Of each digest only the first uncontaminated row is compared
    with others; its copies are exact duplicates of it if it is kept, else near-duplicates of what it is near to.
    The match is the most similar kept row before it, ties to the smaller id. Without ``near`` only digests count.
    """
    known = materialise(gram_sets(reference, n, permutations, seed), "reference")
    sets = materialise(gram_sets(docs, n, permutations, seed, known=KnownGrams(known, reference_threshold, sign_all=near)), "sets")
    bad = materialise(contaminated_sets(sets, known, reference_threshold), "contaminated")
    clean = sets.select("id", "digest", "words", "signature").join(bad.select("id"), "id", "left_anti")
    digests = clean.select("id", "digest")
    first = digests.groupBy("digest").agg(F.min("id").alias("first"))
    digests = digests.join(first, "digest").select("id", "first")
    reps = materialise(clean.join(first.select(F.col("first").alias("id")), "id", "left_semi"), "representatives")
    if near:
        edges = similarities(docs, candidate_pairs(reps.where("words > 0"), threshold, permutations, classes=False), n).where(F.col("similarity") >= threshold)
    else:
        edges = reps.sparkSession.createDataFrame([], "a long, b long, similarity double")
    edges = materialise(edges, "similar")
    state = materialise(keep_first(reps.select("id"), edges), "kept")
    kept = state.where("kept").select(F.col("id").alias("a"))
    best = edges.join(kept, "a").groupBy("b").agg(F.max(F.struct("similarity", (-F.col("a")).alias("m"))).alias("best"))
    first_of = state.join(best, state["id"] == best["b"], "left").select(F.col("id").alias("first"), "kept", (-F.col("best.m")).alias("near"), F.col("best.similarity").alias("near_similarity"))
    own = digests.join(first_of, "first").select(
        "id",
        F.when(~F.col("kept"), "near_duplicate").when(F.col("id") != F.col("first"), "exact_duplicate").otherwise("kept").alias("reason"),
        F.when(~F.col("kept"), F.col("near")).when(F.col("id") != F.col("first"), F.col("first")).alias("match"),
        F.when(~F.col("kept"), F.col("near_similarity")).when(F.col("id") != F.col("first"), F.lit(1.0)).alias("similarity"),
    )
    return bad.select("id", F.lit("contaminated").alias("reason"), "match", "similarity").unionByName(own)


def star_groups(decided: DataFrame) -> DataFrame:
    """``(kept, size, members)`` of duplicates by the row they match; members in order."""
    dropped = decided.where("reason in ('exact_duplicate', 'near_duplicate')")
    return dropped.groupBy(F.col("match").alias("kept")).agg((F.count("*") + 1).alias("size"), F.min("id").alias("first_member"), F.max("id").alias("last_member"), F.round(F.min("similarity"), 6).alias("least_similarity"))


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
