"""Log-likelihood of whole documents under a gated recurrent language model with a class-factored softmax.

Every word of the training documents is in the vocabulary, with its count over all of them. The most frequent words are
the head: they have embeddings and outputs that depend on the state. All other words form tail classes, by a hash of
their endings; a tail word's probability is its class's, which depends on the state, times its smoothed share of the
class's tokens, which leaves one share for words that training didn't see. So the model is a distribution over all words.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import array_slices, held_out, kept, lean, text_slices
from grainmill.plans.shared import materialise

END = b""  # a document's last token; no word is empty
TAILS = 32
SLICE_BYTES = 8_000_000
ROWS = 2048


def words_of(text: str | None) -> list[bytes]:
    """The words and the end of a text: A-Z lower-cased, cut at ASCII white space."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` all those texts, one after the other, and how many each text has."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, offsets = cut.values, cut.offsets.to_numpy()
    held = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False))  # white space at either end cuts off empty ones
    stops = np.searchsorted(held, offsets[1:])
    words = pa.concat_arrays([words.cast(pa.binary()), pa.array([END], pa.binary())])
    return words.take(pa.array(np.insert(held, stops, len(words) - 1))), np.diff(stops, prepend=0) + 1


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n, tail)``: how often each token stands in all of ``docs(text)``, counted in slices before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in array_slices(batch.column(0), SLICE_BYTES):
                counts = words_in(batch.column(0).slice(i, j - i))[0].value_counts()
                yield pa.RecordBatch.from_arrays(counts.flatten(), ["word", "n"])

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tail = pa.array([tail_of(w) for w in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, tail], ["word", "n", "tail"])

    counts = docs.select("text").mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(tails, "word binary, n long, tail int")


def classes(head: int, single: int = 16, size: int = 48) -> list[np.ndarray]:
    """The head's classes, runs of the frequency order: the first words by themselves, then ``size`` words each."""
    return [np.arange(a, min(b, head)) for a, b in [(k, k + 1) for k in range(min(single, head))] + [(k, k + size) for k in range(single, head, size)]]


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent of ``counts(word, n, tail)``, about ``most`` at most.

    A bound on the count is read off a histogram with 64 bins to a doubling, so the driver sees some 2,000 rows and no
    task sends rows that aren't in the answer. Of the bin that would overflow a share is taken by a hash of the word.
    """
    bin_ = F.floor(F.log2("n") * 64)
    sizes = counts.groupBy(bin_.alias("bin")).count().collect()
    left = most
    for r in sorted(sizes, key=lambda r: -r["bin"]):
        if r["count"] > left:
            share = int(1_000_000 * 0.95 * left / r["count"])
            return counts.where((bin_ > r["bin"]) | ((bin_ == r["bin"]) & (F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < share)))
        left -= r["count"]
    return counts


@dataclass
class Vocabulary:
    """The head's words, most frequent first, their classes, and each tail class's tokens and words."""

    head: dict[bytes, int]
    counts: np.ndarray
    classes: list[np.ndarray]  # ids of the head's words by class
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    tokens: int
    words: int

    @classmethod
    def of(cls, counts: DataFrame, size: int) -> Vocabulary:
        """Collects the most frequent words, ``size`` at most, and a row per tail class."""
        top = sorted(frequent_words(counts, size).collect(), key=lambda r: (-r["n"], bytes(r["word"])))
        head = {bytes(r["word"]): k for k, r in enumerate(top)}
        n = np.array([r["n"] for r in top], np.float64)
        tokens, words = np.zeros(TAILS), np.zeros(TAILS)
        for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
            tokens[r["tail"]], words[r["tail"]] = r["n"], r["words"]
        total, distinct = int(tokens.sum()), int(words.sum())
        for r in top:
            tokens[r["tail"]] -= r["n"]
            words[r["tail"]] -= 1
        return cls(head, n, classes(len(top)), tokens, words, total, distinct)


class Encoder(dict):
    """Word -> symbol: a head word's number, or the head's size plus the tail class."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary.head)
        self.size = len(vocabulary.head)

    def __missing__(self, word: bytes) -> int:
        return self.size + tail_of(word)


class Model:
    """A gated recurrent unit; class softmax over head and tail classes, then a softmax inside a head class."""

    NAMES = ("emb", "wh", "bias", "out", "out_bias", "word", "word_bias")

    def __init__(self, vocabulary: Vocabulary, hidden: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        symbols, h = len(vocabulary.head) + TAILS, hidden
        self.hidden, self.symbols, self.n_head = h, symbols, len(vocabulary.head)
        self.classes = vocabulary.classes
        self.n_classes = len(self.classes) + TAILS
        self.class_of = np.empty(symbols, np.int32)
        for c, ids in enumerate(self.classes):
            self.class_of[ids] = c
        self.class_of[self.n_head :] = len(self.classes) + np.arange(TAILS)
        mass = np.array([vocabulary.counts[ids].sum() for ids in self.classes] + list(vocabulary.tail_tokens)) + 1
        f = np.float32
        self.emb = (rng.standard_normal((symbols + 1, 3 * h)) * 0.1).astype(f)  # a symbol's input to the gates; the last starts a document
        self.wh = (rng.standard_normal((h, 3 * h)) / h**0.5).astype(f)
        self.bias = np.zeros(3 * h, f)
        self.out = (rng.standard_normal((h, self.n_classes)) * 0.05).astype(f)
        self.out_bias = np.log(mass / mass.sum()).astype(f)
        self.word = (rng.standard_normal((self.n_head, h)) * 0.05).astype(f)
        self.word_bias = np.log(vocabulary.counts + 1).astype(f)

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def gated(self, gates: np.ndarray, h: np.ndarray):
        """The next state, and what backpropagation needs of the way there; ``gates`` are the inputs to them, with the bias."""
        n, u = self.hidden, h @ self.wh
        zr = gates[:, : 2 * n] + u[:, : 2 * n]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, un = zr[:, :n], zr[:, n:], u[:, 2 * n :]
        c = r * un
        c += gates[:, 2 * n :]
        np.tanh(c, out=c)
        following = h - c
        following *= z
        following += c
        return following, z, r, un, c

    def step(self, x: np.ndarray, h: np.ndarray):
        return self.gated(self.emb[x] + self.bias, h)

    def ready(self) -> None:
        """Lay the gates' weights out for inference: signs and factors of the exponentials are in them."""
        n, table = self.hidden, self.emb + self.bias
        self._zr, self._c = np.ascontiguousarray(-table[:, : 2 * n]), np.ascontiguousarray(-2 * table[:, 2 * n :])
        self._wzr, self._wc = np.ascontiguousarray(-self.wh[:, : 2 * n]), np.ascontiguousarray(-2 * self.wh[:, 2 * n :])

    def infer(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The next state; the same as ``step``'s."""
        n = self.hidden
        zr = self._zr.take(x, 0)
        zr += h @ self._wzr
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c = h @ self._wc
        c *= zr[:, n:]
        c += self._c.take(x, 0)
        np.exp(c, out=c)
        c += 1
        np.divide(2, c, out=c)
        c -= 1
        following = h - c
        following *= zr[:, :n]
        following += c
        return following

    def class_softmax(self, h: np.ndarray, own: np.ndarray, gradient: bool = False):
        """Natural log probabilities of the classes ``own``, some rows at a time, so that they stay in the processor's cache.

        With ``gradient`` also the gradients of their mean, negated. States lie within -1 and 1, so the exponentials can't
        overflow.
        """
        logp, n = np.empty(len(own), np.float32), len(own)
        ones = np.ones(self.n_classes, np.float32)
        if gradient:
            dh, g, back = np.empty_like(h), {"out": np.zeros_like(self.out), "out_bias": np.zeros_like(self.out_bias)}, np.ascontiguousarray(self.out.T)
        for k in range(0, n, ROWS):
            some, at = h[k : k + ROWS], own[k : k + ROWS]
            p, row = some @ self.out, np.arange(len(at))
            p += self.out_bias
            value = p[row, at]
            np.exp(p, out=p)
            total = p @ ones
            value -= np.log(total)
            logp[k : k + ROWS] = value
            if gradient:
                total *= n
                p *= (1 / total)[:, None]
                p[row, at] -= 1 / n
                g["out"] += some.T @ p
                g["out_bias"] += p.sum(0)
                np.matmul(p, back, out=dh[k : k + ROWS])
        return (logp, dh, g) if gradient else logp

    def outputs(self, h: np.ndarray, y: np.ndarray, gradient: bool = False):
        """Natural log probabilities of symbols y; with ``gradient`` also the gradients of their mean, negated."""
        own, n = self.class_of.take(y), len(y)
        if gradient:
            logp, dh, g = self.class_softmax(h, own, True)
            g |= {"word": np.zeros_like(self.word), "word_bias": np.zeros_like(self.word_bias)}
        else:
            logp = self.class_softmax(h, own)
        inside = np.flatnonzero(y < self.n_head)  # sorted by class, so that a class's rows are a slice
        inside = inside[np.argsort(own[inside].astype(np.uint16 if self.n_classes < 1 << 16 else np.int32), kind="stable")]
        cuts = np.searchsorted(own[inside], np.arange(len(self.classes) + 1)).tolist()
        states, place, value = h[inside], y[inside], np.zeros(len(inside), np.float32)
        dh_inside = np.zeros_like(states)
        for c, ids in enumerate(self.classes):
            a, b = cuts[c], cuts[c + 1]
            if a < b and len(ids) > 1:
                lo, hi = ids[0], ids[-1] + 1  # a class is a run of the frequency order
                words, some = self.word[lo:hi], states[a:b]
                q = some @ words.T
                q += self.word_bias[lo:hi] - self.word_bias[lo]
                at = (np.arange(b - a), place[a:b] - lo)
                own_ = q[at]
                np.exp(q, out=q)
                total = q.sum(1)
                value[a:b] = own_ - np.log(total)
                if gradient:
                    total *= n
                    q *= (1 / total)[:, None]
                    q[at] -= 1 / n
                    g["word"][lo:hi] = q.T @ some
                    g["word_bias"][lo:hi] = q.sum(0)
                    np.matmul(q, words, out=dh_inside[a:b])
        logp[inside] += value
        if gradient:
            dh[inside] += dh_inside
        return (logp, dh, g) if gradient else logp

    def log_probability(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.outputs(h, y)

    def train_window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray):
        """Truncated backpropagation through a window (steps, streams); the state before it counts as given."""
        n, (steps, streams) = self.hidden, x.shape
        gates = self.emb.take(x.ravel(), 0)
        gates += self.bias
        gates = gates.reshape(steps, streams, 3 * n)
        states, kept = np.empty((steps + 1, streams, n), np.float32), []
        states[0] = h
        for t in range(steps):
            h, *parts = self.gated(gates[t], states[t])
            states[t + 1] = h
            kept.append(parts)
        logp, dh, g = self.outputs(states[1:].reshape(-1, n), y.ravel(), True)
        dh = dh.reshape(steps, streams, n)
        dx, du, back, turned = np.empty((steps, streams, 3 * n), np.float32), np.empty((steps, streams, 3 * n), np.float32), np.zeros_like(h), np.ascontiguousarray(self.wh.T)
        for t in range(steps - 1, -1, -1):
            z, r, un, c = kept[t]
            d, own, own_u = dh[t], dx[t], du[t]
            d += back
            dz, dr, dc = own[:, :n], own[:, n : 2 * n], own[:, 2 * n :]
            rest = 1 - z
            np.multiply(d, rest, out=dc)
            rest *= z
            np.subtract(states[t], c, out=dz)
            dz *= rest
            dz *= d
            c *= c
            dc *= np.subtract(1, c, out=c)
            np.multiply(dc, r, out=own_u[:, 2 * n :])
            un *= dc
            un *= r
            np.multiply(un, np.subtract(1, r), out=dr)
            own_u[:, : 2 * n] = own[:, : 2 * n]
            d *= z
            back = own_u @ turned
            back += d
        flat = dx.reshape(-1, 3 * n)
        g["wh"] = states[:-1].reshape(-1, n).T @ du.reshape(-1, 3 * n)
        g["bias"] = flat.sum(0)
        g["emb"] = (x.ravel(), flat)
        return float(logp.mean()), h, g


def fresh_memory(model: Model) -> list[np.ndarray]:
    return [np.full_like(p, 1e-6) for p in model.parameters()]


def train(model: Model, stream: np.ndarray, streams: int = 128, steps: int = 16, rate: float = 0.02, passes: int = 1, memory: list[np.ndarray] | None = None) -> float:
    """Adagrad over a token stream, cut into parallel streams whose states are carried from window to window.

    ``memory`` holds the sums of squared gradients so far, a table per parameter, and is added to.
    """
    width = len(stream) // streams
    if width < 2:
        streams, width = 1, len(stream)
    if width < 2:
        return 0.0
    rows = stream[: streams * width].reshape(streams, width).T
    memory = fresh_memory(model) if memory is None else memory
    first, seen = model.symbols, []
    for _ in range(passes):
        h = np.zeros((streams, model.hidden), np.float32)
        for t in range(0, width - 1, steps):
            y = rows[t + 1 : t + 1 + steps]
            x = np.where(rows[t : t + len(y)] == model.end, first, rows[t : t + len(y)])  # after an end a document begins
            mean, h, g = model.train_window(x, y, h)
            seen.append(mean)
            for name, p, m in zip(model.NAMES, model.parameters(), memory):
                if name == "emb":
                    ids, rows_g = g["emb"]
                    order = np.argsort(ids.astype(np.uint16) if model.symbols < 1 << 16 else ids, kind="stable")
                    ids = ids[order]
                    starts = np.flatnonzero(np.diff(ids, prepend=-1))
                    used, sums = ids[starts], np.add.reduceat(rows_g.take(order, 0), starts, axis=0)
                    m[used] += sums * sums
                    p[used] -= rate * sums / np.sqrt(m[used])
                else:
                    m += g[name] * g[name]
                    p -= rate * g[name] / np.sqrt(m)
    return float(np.mean(seen[-50:])) if seen else 0.0


def symbol_type(symbols: int) -> str:
    """As small as holds every symbol and the one that starts a document."""
    return "<u2" if symbols + 1 < 1 << 16 else "<i4"


def draws(rounds: int) -> list[Column]:
    """Of rows with doc_id and text: what picks the start's documents, the order of those, and the round of training."""
    pick, part = (F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(n)) for seed, n in ((0, 1_000_000), (2, rounds)))
    return [pick.alias("pick"), F.xxhash64("doc_id", F.lit(1)).alias("place"), part.alias("round")]


def train_all(model: Model, texts: Iterator[list[np.ndarray]], memory: list[np.ndarray], chunk: int = 1_000_000) -> int:
    """Train on every token of the documents, about ``chunk`` at a time; the number of tokens.

    A chunk is filled up to equal streams with tokens from its start, so that none is left out.
    """
    held, size, seen = [], 0, 0

    def step() -> None:
        stream = np.concatenate(held)
        streams = max(1, min(512, len(stream) // 64))
        train(model, np.resize(stream, -(-len(stream) // streams) * streams), streams, memory=memory)

    for some in texts:
        for ids in some:
            held.append(ids)
            size += len(ids)
            if size >= chunk:
                step()
                held, seen, size = [], seen + size, 0
    if size:
        step()
    return seen + size


def mean_models(trained: DataFrame, fan_in: int = 4) -> tuple[int, np.ndarray | None]:
    """Tokens, and the mean of ``trained(part, tokens, weights)`` by tokens; summed in groups before the driver sees them."""

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["tokens"].to_pylist(), table["weights"].to_pylist()), key=lambda r: r[0])
        total = sum(np.frombuffer(w, "<f4").astype(np.float64) * n for _, n, w in rows) / sum(n for _, n, _ in rows)
        return pa.table({"part": pa.array([rows[0][0]], pa.int64()), "tokens": pa.array([sum(r[1] for r in rows)], pa.int64()), "weights": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    while (n := trained.count()) > fan_in:
        groups = trained.groupBy((F.col("part") % (-(-n // fan_in))).alias("g"))
        trained = materialise(groups.applyInArrow(lambda table: add(table), "part long, tokens long, weights binary"), "models")
    rows = trained.collect()
    if not rows:
        return 0, None
    one = add(pa.table({"part": [r["part"] for r in rows], "tokens": [r["tokens"] for r in rows], "weights": pa.array([bytes(r["weights"]) for r in rows], pa.binary())}))
    return one["tokens"][0].as_py(), np.frombuffer(one["weights"][0].as_py(), "<f4")


def fit(docs: DataFrame, vocabulary: Vocabulary, hidden: int = 32, warm_tokens: int = 1_200_000, passes: int = 2, rounds: int = 4) -> Model:
    """Train on every document of ``docs(doc_id, text)``, as ``fit_symbols`` does."""
    encoder, kind = Encoder(vocabulary), symbol_type(len(vocabulary.head) + TAILS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array([*map(encoder.__getitem__, words_of(t.as_py()))], kind).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *batch.columns[1:]], ["ids", "pick", "place", "round"])

    rows = docs.select("text", *draws(rounds)).mapInArrow(lean(run), "ids binary, pick long, place long, round long")
    return fit_symbols(materialise(rows, "symbols"), vocabulary, hidden, warm_tokens, passes, rounds)


def fit_symbols(docs: DataFrame, vocabulary: Vocabulary, hidden: int, warm_tokens: int, passes: int = 2, rounds: int = 4) -> Model:
    """Train on every document of ``docs(ids, pick, place, round)``, whatever the size of the table; ids are symbols.

    The model starts from documents with about ``warm_tokens`` tokens, picked by a hash of id and text, so that the models
    of the partitions lie close together. Then each partition trains on all its documents, in ``rounds`` parts by
    hash; after each the models and their sums of squared gradients are averaged by tokens. ``trained_tokens`` is the
    number of tokens of those rounds, which is all there are.
    """
    model = Model(vocabulary, hidden)
    model.end = vocabulary.head.get(END, 0)
    model.trained_tokens = 0
    if not vocabulary.tokens:
        return model
    share, kind = min(1.0, warm_tokens / vocabulary.tokens), symbol_type(model.symbols)
    rows = docs.where(F.col("pick") < int(share * 1_000_000) + 1).select("ids", "place").orderBy("place", "ids").collect()  # some bytes a token
    memory = fresh_memory(model)
    train(model, np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), kind).astype(np.int32), passes=passes, memory=memory)
    del rows
    sizes = np.cumsum([p.size for p in model.parameters() + memory])[:-1]

    def flat(model: Model, memory: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([p.ravel() for p in model.parameters() + memory]).astype("<f4")

    def load(model: Model, memory: list[np.ndarray], values: np.ndarray) -> None:
        for p, v in zip(model.parameters() + memory, np.split(values, sizes)):
            p[...] = v.reshape(p.shape)

    for k in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((vocabulary, flat(model, memory)))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            words, values = sent.value
            own = Model(words, hidden)
            own.end = words.head.get(END, 0)
            sums = fresh_memory(own)
            load(own, sums, values)
            symbols = ([np.frombuffer(x.as_buffer(), kind).astype(np.int32) for x in batch.column(0)] for batch in batches)
            tokens = train_all(own, symbols, sums)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([tokens], pa.int64()), pa.array([flat(own, sums).tobytes()], pa.binary())], ["part", "tokens", "weights"])

        some = docs.where(F.col("round") == k).select("ids")
        tokens, values = mean_models(materialise(some.mapInArrow(lean(part), "part long, tokens long, weights binary"), "models"))
        if tokens:
            load(model, memory, values)
            model.trained_tokens += tokens
        sent.destroy()
    return model


def score_batch(model: Model, symbols: list[np.ndarray], most_lanes: int = 384, steps: int = 32) -> np.ndarray:
    """log10 probability of each document's symbols; documents run side by side, each with its state carried on.

    A lane takes the next document when its own ends, so that long documents don't hold up short ones.
    """
    order = sorted(range(len(symbols)), key=lambda k: -len(symbols[k]))
    total = sum(map(len, symbols))
    lanes = min(most_lanes, max(64, 2 * total // max(1, max(map(len, symbols), default=1))), len(order)) or 1
    # Longest first, each to the least filled lane: lanes end at about the same time.
    heads = np.zeros(lanes, np.int64)
    own: list[list[int]] = [[] for _ in range(lanes)]
    heap = [(0, k) for k in range(lanes)]
    for d in order:
        load, lane = heapq.heappop(heap)
        own[lane].append(d)
        heapq.heappush(heap, (load + len(symbols[d]), lane))
    longest = max((sum(len(symbols[d]) for d in ds) for ds in own), default=0)
    heads[:] = [sum(len(symbols[d]) for d in ds) for ds in own]
    lane_order = np.argsort(-heads, kind="stable")
    y = np.zeros((longest, lanes), np.int32)
    doc = np.full((longest, lanes), len(symbols), np.int32)
    for at, lane in enumerate(lane_order.tolist()):
        if own[lane]:
            y[: heads[lane], at] = np.concatenate([symbols[d] for d in own[lane]])
            doc[: heads[lane], at] = np.repeat(own[lane], [len(symbols[d]) for d in own[lane]])
    x = np.empty_like(y)
    x[:1] = model.symbols
    if longest:
        x[1:] = np.where(doc[1:] != doc[:-1], model.symbols, y[:-1])
    model.ready()
    totals = np.zeros(len(symbols) + 1)
    h = np.zeros((lanes, model.hidden), np.float32)
    live = np.sort(heads)[::-1]
    for t in range(0, longest, steps):
        width = int(np.searchsorted(-live, -t, "left"))
        h = h[:width]
        hs = []
        span = range(t, min(t + steps, longest))
        for s in span:
            fresh = x[s, :width] == model.symbols
            if fresh.any():
                h = np.where(fresh[:, None], np.float32(0), h)
            h = model.infer(x[s, :width], h)
            hs.append(h)
        ds = doc[span.start : span.stop, :width].ravel()
        ok = ds < len(symbols)
        logp = model.log_probability(np.concatenate(hs)[ok], y[span.start : span.stop, :width].ravel()[ok])
        totals += np.bincount(ds[ok], logp, len(totals))
    return totals[:-1] / np.log(10)


def at_hand(name: str, words) -> pa.Array:
    """The broadcast words, laid out once per Python worker."""
    return kept(name, lambda: pa.array(words.value, pa.binary()))


def score_documents(docs: DataFrame, head: int = 1552, hidden: int = 24, warm_tokens: int = 1_200_000, known_words: int = 262_144) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs(doc_id, text)``.

    Held out are rows whose crc32(doc_id) leaves 2 by 7 (a null id counts as empty text); the others are trained on.
    base_score is the smoothed unigram's log10 probability, score the model's. The ``known_words`` most frequent words'
    counts, a bounded table, are at hand where the text is read; of rarer words, (document, word, times) rows meet their
    counts in a join, so that no table that grows is broadcast. Texts are read twice, to count words and to turn them into
    symbols, two bytes each on disk, which training and scoring read. Null texts count as empty, with the end as only
    token; rows that repeat an id are each scored; other columns are ignored; an empty table gives no rows.
    """
    rounds = 4
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    training = rows.where(~held_out(F.col("doc_id"), 7))
    counts = materialise(word_counts(training), "counts")
    vocabulary = Vocabulary.of(counts, head)
    n_head, space = len(vocabulary.head), vocabulary.tokens + vocabulary.words + 1
    name, kind = uuid.uuid4().hex, symbol_type(n_head + TAILS)
    log_space = float(np.log10(space))
    frequent = [(bytes(r["word"]), r["n"]) for r in frequent_words(counts, known_words).select("word", "n").collect()]
    frequent = [(w, n) for w, n in frequent if w not in vocabulary.head]
    rest = np.log10(vocabulary.tail_tokens + vocabulary.tail_words + 1)
    # Of the words at hand, head words first, by place; the last is for words that are not: symbol, log count, share in its class.
    tails = np.array([tail_of(w) for w, _ in frequent], np.int64)
    symbol_of = np.concatenate([np.arange(n_head), n_head + tails, [0]]).astype(kind)
    times_of = np.append(np.log10(np.concatenate([vocabulary.counts, np.array([n for _, n in frequent], float)]) + 1), 0.0)
    share_of = np.concatenate([np.zeros(n_head), times_of[n_head:-1] - rest[tails], [0.0]])
    sent = docs.sparkSession.sparkContext.broadcast([*vocabulary.head, *(w for w, _ in frequent)])
    del frequent

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, own = TaskContext.get().partitionId() << 36, at_hand(name, sent)
        for batch in batches:
            for i, j in array_slices(batch.column(0), SLICE_BYTES):
                n = j - i
                words, sizes = words_in(batch.column(0).slice(i, n))
                places = pc.index_in(words, value_set=own).fill_null(-1).to_numpy()
                starts, stops = np.cumsum(sizes) - sizes, np.cumsum(sizes)
                symbols, shares = symbol_of[places], share_of[places]
                lost = np.flatnonzero(places < 0)
                rare = words.take(pa.array(lost)).dictionary_encode()
                codes, names = rare.indices.to_numpy(), rare.dictionary
                tail = np.fromiter(map(tail_of, names.to_pylist()), np.int64, len(names))[codes]
                symbols[lost], shares[lost] = n_head + tail, -rest[tail]
                doc = np.searchsorted(stops, lost, "right")
                found, times = np.unique(doc * max(1, len(names)) + codes, return_counts=True)  # a rare word of a document once
                cuts = np.searchsorted(found, np.arange(n + 1) * max(1, len(names)))
                pairs = pa.StructArray.from_arrays([names.take(pa.array(found % max(1, len(names)))), pa.array(times)], ["word", "times"])
                base = np.add.reduceat(times_of[places], starts) - sizes * log_space
                octets = np.concatenate([[0], stops * symbols.itemsize]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(octets), pa.py_buffer(symbols)])
                known = sizes - np.bincount(doc, minlength=n)
                columns = [row + np.arange(n), *(c.slice(i, n) for c in batch.columns[1:]), sizes, known, base, np.add.reduceat(shares, starts), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs), ids]
                row += n
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["row", "doc_id", "pick", "place", "round", "n_tokens", "known", "base", "share", "rare", "ids"])

    ddl = "row long, doc_id long, pick long, place long, round long, n_tokens long, known long, base double, share double, rare array<struct<word:binary,times:long>>, ids binary"
    read_ = materialise(rows.select("text", "doc_id", *draws(rounds)).mapInArrow(lean(read, keeps=True), ddl), "symbols")
    model = fit_symbols(read_.where(~held_out(F.col("doc_id"), 7)).select("ids", "pick", "place", "round"), vocabulary, hidden, warm_tokens, rounds=rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), kind).astype(np.int32) for x in batch.column(5)]
            for i, j in text_slices(ids, 1_000_000):
                scores = score_batch(model, ids[i:j]) + batch.column(6).slice(i, j - i).to_numpy()
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:5]), pa.array(scores, pa.float64())], ["row", "doc_id", "n_tokens", "known", "base", "score"])

    scored = read_.select("row", "doc_id", "n_tokens", "known", "base", "ids", "share").mapInArrow(lean(score), "row long, doc_id long, n_tokens long, known long, base double, score double")
    scored = materialise(scored, "scored")
    rare = read_.select("row", F.explode("rare").alias("t")).select("row", "t.word", "t.times")
    joined = rare.join(counts.select("word", "n"), "word")
    sums = joined.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1) * F.col("times")).alias("share"), F.sum("times").alias("seen"))
    out = scored.join(sums, "row", "left")
    share, seen = F.coalesce("share", F.lit(0.0)), F.coalesce("seen", F.lit(0))  # a word that training lacks adds log10(1)
    return out.select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "n_tokens", (F.col("known") + seen).alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + share).alias("base_score"), (F.col("score") + share).alias("score"))
