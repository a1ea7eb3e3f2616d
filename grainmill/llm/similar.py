"""Words and runs of words of texts as hashes, and exact similarity joins inside groups of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import lean

GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers below n, modulo 2**64."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(max(n, 1 << 16), np.uint64(base))
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    if n <= 1 << 20:  # those for a very long text are not kept
        _POWERS[:] = both
    return both[0][:n], both[1][:n]


class Words:
    """The words of some texts at once: where they are, hashes of them (A-Z lower-cased) and of runs of five."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        data = self.data = np.frombuffer(b"\n".join([*raw, b""]) if raw else b"", np.uint8)
        self.at = np.cumsum(sizes) - sizes  # where each text begins
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64) + np.uint64(1)
        up, down = powers(len(data) + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lower * up[: len(data)])])
        w = self.word = mix((prefix[self.end] - prefix[self.start]) * down[self.start])
        self._prefix, self._down = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)])]), down
        self.doc = np.searchsorted(self.at, self.start, "right") - 1
        self.shingle = mix(w[:-4] + w[1:-3] * np.uint64(3) + w[2:-2] * np.uint64(5) + w[3:-1] * np.uint64(7) + w[4:] * np.uint64(11)) if len(w) > 4 else np.zeros(0, np.uint64)

    def content(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of words a to b, wherever they stand."""
        return mix((self._prefix[b] - self._prefix[a]) * self._down[a] + (b - a).astype(np.uint64) * GOLD).view(np.int64)

    def sets(self) -> list[np.ndarray]:
        """Each text's distinct runs of five words, as sorted hashes; one run of all words if there are fewer."""
        cuts = np.searchsorted(self.doc, np.arange(len(self.at) + 1)).tolist()
        whole = lambda a, b: self.content(np.array([a]), np.array([b])).view(np.uint64)
        return [np.unique(self.shingle[a : b - 4]) if b - a > 4 else whole(a, b) if b > a else np.zeros(0, np.uint64) for a, b in zip(cuts, cuts[1:])]


class Union(dict):
    """Sets of numbers, each known by its root."""

    def find(self, x: int) -> int:
        root = x
        while self.setdefault(root, root) != root:
            root = self[root]
        while self[x] != root:
            self[x], x = root, self[x]
        return root

    def join(self, x: int, y: int) -> None:
        self[self.find(x)] = self.find(y)


def similar_links(tokens: list[np.ndarray], threshold: float, side: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of sets with at least that Jaccard similarity which join the same components as all such pairs do.

    Sets so similar share one of their first n - ceil(threshold * n) + 1 tokens in any order common to all; the rarest
    come first. Each set is held against one component of earlier sets after another and compared with its members
    until one is similar, so m alike sets give m - 1 links and about as many comparisons. With ``side`` only sets of
    different sides are compared, and each side's own links are not looked for.
    """
    sizes = np.array([len(t) for t in tokens])
    owner = np.repeat(np.arange(len(tokens)), sizes)
    values, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    order = np.lexsort((inverse, counts[inverse], owner))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(int) + 1
    inverse, owner = inverse[order], owner[order]
    ok = (rank < prefix[owner]) & (counts[inverse] > 1)
    inverse, owner = inverse[ok], owner[ok]
    cuts = np.searchsorted(owner, np.arange(len(tokens) + 1))
    sets: dict[int, frozenset] = {}
    of = lambda k: sets.get(k) or sets.setdefault(k, frozenset(tokens[k].tolist()))
    union = Union()
    posted: dict[int, dict[int, list[int]]] = {}  # token -> component as it was then -> its sets with that token
    for j in range(len(tokens)):
        mine = inverse[cuts[j] : cuts[j + 1]].tolist()
        tried: set[int] = set()
        for token in mine:
            for root, members in posted.get(token, {}).items():
                if union.find(root) == union.find(j):
                    continue
                for i in reversed(members):
                    if i in tried or (side and side[i] == side[j]) or min(sizes[i], sizes[j]) < threshold * max(sizes[i], sizes[j]) - 1e-9:
                        continue
                    tried.add(i)
                    p, q = of(i), of(j)
                    both = len(p & q)
                    if both >= threshold * (len(p) + len(q) - both) - 1e-9:
                        union.join(j, i)
                        yield i, j
                        break
        root = union.find(j)
        for token in mine:
            posted.setdefault(token, {}).setdefault(root, []).append(j)


def group_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: links that join what has a Jaccard similarity of ``threshold`` or more inside a group.

    ``members(key, member, blocks)`` are the groups and ``sets(member, shingles)`` the members' sets. A group is cut into
    ``blocks`` by member, and each pair of its blocks is a task's work of its own, so no task holds more than two.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = members.join(sets, "member").select("key", "member", "shingles", F.pmod("member", "blocks").cast("int").alias("own"), other.alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "member", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, tokens, side = None, [], [], []

        def out() -> pa.RecordBatch:
            pairs = list(similar_links(tokens, threshold, side if last[1] != last[2] else None))
            a, b = ([ids[p[k]] for p in pairs] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for *key, own, member, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    if len(tokens) > 1:
                        yield out()
                    last, ids, tokens, side = key, [], [], []
                ids.append(member)
                tokens.append(np.frombuffer(raw, np.uint64))
                side.append(own)
        if len(tokens) > 1:
            yield out()

    return rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "member").mapInArrow(lean(compare), "a long, b long")
