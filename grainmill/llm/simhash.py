"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import is_marked, lean, marked, text_slices
from grainmill.llm.similar import GOLD, Words, group_links, mix
from grainmill.plans.components import connected_components
from grainmill.plans.shared import materialise

SEED = 42
BLOCK = 512


def shingle_spans(words: list[bytes], n: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and where each run of n words begins and ends there (one run if there are fewer)."""
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= n:
        return text, [0], [len(text)]
    starts = np.concatenate([[0], ends[:-n] + 1])
    return text, starts.tolist(), ends[n - 1 :].tolist()


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """XXH64 of each run of n words, in order; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, starts, ends = shingle_spans(words, n)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends)), "<u8", len(starts))


def majority(hashes: np.ndarray) -> int:
    """64-bit SimHash, as a signed long: a bit is 1 if more than half the hashes have it."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        octets = hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, fingerprint)`` of ``docs(doc_id, text)``; null texts count as empty (fingerprint 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(text.as_py() or "", words)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fingerprint"])

    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return docs.mapInArrow(lean(run), "doc_id long, fingerprint long")


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of 64 bits of which one differs by at most one bit if ``bits`` do."""
    count = bits // 2 + 1
    cuts = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(prints: np.ndarray, cut: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """One key per bit of every print: the bit's segment without that bit, tagged by the bit. Shape (prints, 64)."""
    u = prints.view(np.uint64)
    keys = np.empty((len(u), 64), np.int64)
    for first, width in cut:
        part = (u >> np.uint64(first)) & np.uint64((1 << width) - 1)
        for bit in range(width):
            rest = part & ~np.uint64(1 << bit)
            keys[:, first + bit] = (rest | np.uint64((first + bit) << 57)).view(np.int64)
    return keys


def _near(prints: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different prints of one bucket with at most ``bits`` differing bits, a block against a block at a time."""
    u = prints.view(np.uint64)
    for i in range(0, len(u), BLOCK):
        for j in range(i, len(u), BLOCK):
            d = np.bitwise_count(u[i : i + BLOCK, None] ^ u[None, j : j + BLOCK])
            a, b = np.nonzero(d <= bits)
            a, b = a + i, b + j
            ok = a < b
            if ok.any():
                yield prints[a[ok]], prints[b[ok]]


def links(prints: DataFrame, bits: int = 4, hot: int = 4096) -> DataFrame:
    """``(a, b)``: links that join every two different prints at ``bits`` or fewer differing bits into one component.

    ``prints(fingerprint)`` holds each print once. A print is indexed under one key for each of its 64 bits: the bit's
    segment with that bit deleted. With ``bits // 2 + 1`` segments two prints that close agree in a segment but for one
    bit, so they share a key. Sorted by key, a task reads a bucket at a time and compares it in blocks.

    A bucket of more than ``hot`` prints is not compared: its prints agree in one segment but for a bit, so the other
    bits differ by at most ``bits``, and it is indexed again over those, by the same rule, inside the bucket. What is
    still larger then is compared block by block. No bucket is cut off, so no link is lost.
    """
    cut = segments(bits)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(column), 4096):
                some = column[k : k + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(variants(some, cut).ravel()), pa.array(np.repeat(some, 64))], ["key", "fingerprint"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def compared(bucket: np.ndarray, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if len(bucket) <= hot:
                yield from _near(bucket, bits)
                return
            bit = (key >> 57) & 63
            first, width = next(c for c in cut if c[0] <= bit < c[0] + c[1])
            rest = [b for b in range(64) if not first <= b < first + width]
            for part in np.array_split(np.array(rest), bits // 2 + 1):
                for deleted in part:
                    mask = np.uint64(sum(1 << int(b) for b in part if b != deleted))
                    inner = bucket.view(np.uint64) & mask
                    order = np.argsort(inner, kind="stable")
                    edges = np.flatnonzero(np.diff(inner[order])) + 1
                    for some in np.split(bucket[order], edges):
                        if len(some) > 1:
                            yield from _near(some, bits)

        a, b, size = [], [], 0
        for key, bucket in _buckets(batches):
            for x, y in compared(bucket, key):
                a.append(x)
                b.append(y)
                size += len(x)
                if size > 200_000:
                    yield out(a, b)
                    a, b, size = [], [], 0
        yield out(a, b)

    indexed = prints.select("fingerprint").mapInArrow(lean(index), "key long, fingerprint long")
    ordered = indexed.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(lean(verify), "a long, b long")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(key, prints) of every key with two prints or more, from rows in order of the key."""
    last, held = None, []
    for batch in batches:
        key, value = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else []
        for a, b in zip(cuts, cuts[1:]):
            if held and (key[a] != last):
                if len(held) > 1 or len(held[0]) > 1:
                    yield int(last), np.concatenate(held)
                held = []
            last = key[a]
            held.append(value[a:b])
    if held and (len(held) > 1 or len(held[0]) > 1):
        yield int(last), np.concatenate(held)


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for ``docs(doc_id, text)``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and into runs of ``words`` words, repeats
    included. Documents whose fingerprints differ by ``bits`` bits or fewer are linked; the component is the smallest
    doc_id that links reach. Fingerprints are compared once each, however many documents have them.

    Null and empty texts have fingerprint 0, which links like any other. A row with a null id has a null component and
    takes no part in links. Repeated rows stay, with the same result; an empty table gives no rows; other columns are
    ignored.
    """
    prints = materialise(fingerprints(docs, words), "prints")
    classes = prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    found = connected_components(links(classes, bits), "a", "b")
    rooted = classes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = rooted.select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    smallest = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = rooted.join(smallest, "component").select("fingerprint", "component_id")
    out = prints.join(labels, "fingerprint", "left")
    return out.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# Near copies by the similarity of sets


def layout(n: int) -> tuple[int, int]:
    """Number and width of segments for n texts: wider ones, and so more of them, for more texts.

    Texts of similarity 0.8 differ in 15 % of the bits. A segment of 16, 20 or 24 bits then differs by one bit at most
    with a probability of 0.28, 0.17 or 0.10; of 8, 14 or 24 segments some one does with 0.93 (0.975 at 0.85, 0.99 at 0.9).
    Unlike texts share a key with a probability of about 2**-9, 2**-11 or 2**-14.
    """
    return (8, 16) if n <= 1 << 21 else (14, 20) if n <= 1 << 26 else (24, 24)


def set_print(hashes: np.ndarray, bits: int) -> bytes:
    """SimHash of ``bits`` bits (a multiple of 8) of distinct hashes."""
    total = np.zeros(-(-bits // 64) * 64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        for k in range(len(total) // 64):
            octets = mix(part + np.uint64(k * int(GOLD) % (1 << 64))).view(np.uint8).reshape(-1, 8)
            total[64 * k : 64 * k + 64] += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * total[:bits] > len(hashes)).tobytes()


def _paired(ids: np.ndarray, u: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside buckets, given as runs of rows, between prints u (rows, 2) with at most ``most`` differing bits.

    Rows of small buckets are compared with the next ones, all buckets at once; larger ones block by block, where links
    inside what is joined already are left out.
    """
    near = lambda x, y: np.bitwise_count(u[x] ^ u[y]).sum(-1, dtype=np.int64) <= most
    left = np.repeat(np.where(sizes <= small, sizes, 0), sizes) - (np.arange(len(ids)) - np.repeat(starts, sizes))  # rows from here to the bucket's end
    at = np.arange(len(ids))
    for shift in range(1, small):
        at = at[left[at] > shift]
        if not len(at):
            break
        hit = at[near(at, at + shift)]
        if len(hit):
            yield ids[hit], ids[hit + shift]
    for k in np.flatnonzero(sizes > small).tolist():
        rows = np.arange(starts[k], starts[k] + sizes[k])
        label = np.arange(len(rows))
        for i in range(0, len(rows), BLOCK):
            for j in range(i, len(rows), BLOCK):
                x, y = np.arange(i, min(i + BLOCK, len(rows))), np.arange(j, min(j + BLOCK, len(rows)))
                ok = np.bitwise_count(u[rows[x], None, 0] ^ u[None, rows[y], 0]) + np.bitwise_count(u[rows[x], None, 1] ^ u[None, rows[y], 1]) <= most
                while True:
                    p, q = np.nonzero(ok & (label[x][:, None] != label[y][None]))
                    if not len(p):
                        break
                    a, b = x[p[0]], y[q[0]]  # join all that touch one of the two, then look again
                    touch = np.unique(np.concatenate([label[y[q[label[x[p]] == label[a]]]], label[x[p[label[y[q]] == label[a]]]]]))
                    yield ids[rows[np.full(len(touch), a)]], ids[rows[touch]]
                    label[np.isin(label, touch)] = label[a]
                    del b


def candidate_links(classes: DataFrame, count: int, width: int, most: int = 32) -> DataFrame:
    """``(a, b)``: links between nodes of ``classes(node, print)`` that share a key and differ by ``most`` of the first 128 bits.

    Each of a print's ``count`` segments gives ``width`` keys: the segment without one bit, tagged by the bit. Texts of
    similarity 0.8 differ by 19.4 of 128 bits, with a standard deviation of 4.1; unlike ones by 64 and 5.7.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                ids = batch.column(0).slice(at, 4096)
                raw = np.frombuffer(b"".join(batch.column(1).slice(at, 4096).to_pylist()), np.uint8).reshape(len(ids), -1)
                segment = np.unpackbits(raw, axis=1)[:, : count * width].reshape(-1, count, width) @ (1 << np.arange(width, dtype=np.int64))
                rest = segment[:, :, None] & ~(1 << np.arange(width, dtype=np.int64))
                keys = rest | (np.arange(count * width, dtype=np.int64) << 32).reshape(count, width)
                u = np.ascontiguousarray(raw[:, :16]).view(np.int64)
                rows = np.repeat(np.arange(len(ids)), count * width)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), ids.take(pa.array(rows)), pa.array(u[rows, 0]), pa.array(u[rows, 1])], ["key", "node", "high", "low"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, ids, *u = columns
            starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(key)))
            for a, b in _paired(ids, np.stack(u, axis=1).view(np.uint64), starts, sizes, most):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[list[np.ndarray]] = []  # of the bucket that a batch ended in
        for batch in batches:
            if batch.num_rows:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                last = int(np.searchsorted(columns[0], columns[0][-1]))
                if last or (held and held[-1][0][-1] != columns[0][0]):
                    yield from out([np.concatenate(c) for c in zip(*held, [c[:last] for c in columns])])
                    held = []
                held.append([c[last:] for c in columns])
        if held:
            yield from out([np.concatenate(c) for c in zip(*held)])

    indexed = classes.select("node", "print").mapInArrow(lean(index), "key long, node long, high long, low long")
    return indexed.repartition("key").sortWithinPartitions("key").mapInArrow(lean(compare), "a long, b long")


def similar_documents(docs: DataFrame, similarity: float = 0.8, most_in_group: int = 4096) -> DataFrame:
    """``(doc_id, row, keeper)`` of ``docs(doc_id, text)`` that have words: the smallest doc_id of its near copies.

    Texts are sets of runs of five words (A-Z lower-cased). Equal sets are one node. Nodes' SimHashes are indexed by
    one-wildcard segments (``layout``) and give candidate links, which fall into groups. Of members of groups the texts
    are read again, and exact Jaccard similarities of whole sets decide which are linked; the keeper is the least of all
    that links reach. row, the hash of the text, tells rows of one id apart. Nodes are 64-bit hashes of sets, so two
    different sets are taken for one with a chance of 1 in 10**19 a pair.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("row"), docs["text"].alias("text")).where("doc_id is not null")

    def sets_of(texts: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
        for i, j in text_slices(texts, 400_000):
            yield i, Words(texts[i:j]).sets()

    node_of = lambda x: xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63)
    count, width = layout(rows.count())

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sets in sets_of([t or "" for t in batch.column(2).to_pylist()]):
                some = batch.slice(i, len(sets))
                out = [(node_of(x), set_print(x, count * width)) if len(x) else (None, None) for x in sets]
                node, bits = zip(*out)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(node, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "row", "node", "print"])

    printed = materialise(rows.mapInArrow(lean(prints), "doc_id long, row long, node long, print binary").where("node is not null"), "prints")
    classes = materialise(printed.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("print").alias("print")), "classes")
    groups = materialise(connected_components(candidate_links(classes, count, width), "a", "b"), "groups")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / most_in_group).cast("int").alias("blocks"))
    members = groups.join(sizes, "component").select(F.col("component").alias("key"), F.col("node").alias("member"), "blocks")
    wanted = materialise(classes.join(groups, "node").select(F.xxhash64("first").alias("hash")), "wanted")
    bitmap, bits = marked(wanted, wanted.count())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = is_marked(shared.value, batch.column(0).to_numpy(zero_copy_only=False), bits)
            texts = [t or "" for t in batch.column(1).filter(pa.array(ok)).to_pylist()]
            for _, sets in sets_of(texts):
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["member", "shingles"])

    again = rows.select(F.xxhash64("doc_id").alias("hash"), "text").mapInArrow(lean(fetch), "member long, shingles binary")
    links = group_links(members, again.dropDuplicates(["member"]), similarity)
    found = connected_components(links, "a", "b")
    rooted = classes.select("node", "first").join(found, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    keepers = rooted.groupBy("component").agg(F.min("first").alias("keeper"))
    return printed.join(rooted.join(keepers, "component").select("node", "keeper"), "node").select("doc_id", "row", "keeper")


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the near copies of a document with a smaller doc_id (see ``similar_documents``).

    Rows with a null id stay, and so do texts without words; of equal rows of one id all stay. All columns are kept as
    they are; an empty table gives no rows.
    """
    found = similar_documents(docs, similarity).where("doc_id <> keeper")
    gone = found.select(F.col("doc_id").alias("_dropped"), F.col("row").alias("_row")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_dropped"]) & (F.xxhash64(docs["text"]) == gone["_row"]), "left_anti")
