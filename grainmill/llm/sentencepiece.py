"""SentencePiece encoding by matching every piece in a suffix array of the batch, and decoding."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grainmill.llm.common import kept, lean, text_slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BATCH_CHARS = 1_000_000
CACHE_WORDS = 200_000
SLICE_CHARS = 300_000
LONG_WORD = 64
TABLE_BITS = 21


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """Pieces, scores and kinds of a model file; only models that leave texts as they are but for spaces are accepted."""

    def __init__(self, path: str):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        self.prefix, self.trim = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        if normalizer.get(2) or self.trim or not self.bpe:
            raise ValueError("only byte-pair models with the identity normaliser, which keep their white space, are supported")
        self.bytes = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = self.kinds.index(UNKNOWN)
        self.own = {p: k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind in (NORMAL, USER)}


def suffix_array(text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The suffixes of the code points in order of their first ``longest`` characters or more, by prefix doubling.

    Also the rank of each code point, from 1 on; the first characters' ranks of the suffixes in that order, packed into
    an integer each; and how many characters that is.
    """
    ranks = np.zeros(max(int(text.max(initial=0)) + 1, 1 << 16), np.int64)
    ranks[text] = 1
    distinct = np.flatnonzero(ranks)
    ranks[distinct] = np.arange(1, len(distinct) + 1)
    rank, bits = ranks[text], len(distinct).bit_length()
    first = step = max(1, min(62 // max(1, bits), longest))  # as many characters as fit are the first rank
    packed = np.zeros(len(text) + step, np.int64)
    for k in range(step):
        packed[: max(0, len(text) - k)] |= rank[k:] << (bits * (step - 1 - k))
    pair = packed = packed[: len(text)]
    while True:
        order = np.argsort(pair)
        if step >= longest or step >= len(text):
            return order, ranks, packed[order], first
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], np.diff(pair[order]) != 0]))
        nxt = np.zeros_like(rank)
        nxt[:-step] = rank[step:]
        pair, step = rank << 32 | nxt, 2 * step


class Encoder:
    """Encodes as the model's merges do.

    A batch's distinct words, one after another with ends between them, are indexed by a suffix array; binary search
    finds the range of suffixes that begin with each piece, all pieces at once, and so every edge (from, to, piece).
    Edges are sorted by position and relaxed from left to right. Merging is not a best path by summed scores, so
    relaxing takes, for each end, the one edge whose piece may follow the best encoding up to its start: a pair of
    pieces may stand side by side if merging their joint text leaves both. For each prefix of a text that is its last
    token. All words are relaxed together, their k-th ends in one step; those of more than LONG_WORD characters one by
    one. A word begins at a space, since no piece has a space after another character.
    """

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.joins = any(SPACE in p.lstrip(SPACE) for p in v.own)
        self.halves: dict[str, list[str]] = {}
        names = []
        for name in sorted(v.own):
            parts = self.merge(name, 2)
            if len(name) == 1 or (len(parts) == 2 and "".join(parts) in v.own):
                names.append(name)
                if len(name) > 1:
                    self.halves[name] = parts
        self.longest = max(map(len, names))
        self.piece_ids = np.array([v.own[p] for p in names], np.int64)
        self.piece_lengths = np.array([len(p) for p in names], np.int64)
        self.matrix = np.zeros((len(names), self.longest), np.int64)
        for k, p in enumerate(names):
            self.matrix[k, : len(p)] = [ord(c) for c in p]
        self.length = [len(p) for p in v.pieces]
        self.lengths = np.array(self.length, np.int64)
        self.table = np.full(1 << TABLE_BITS, -1, np.int64)  # twice a pair's key, and 1 if it stays
        self.allowed: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before, once CACHE_WORDS are held

    def merge(self, text: str, least: int = 1) -> list[str]:
        """The pieces of a short text by merging: the best score first, the leftmost of equal ones; down to ``least``."""
        parts, own, scores = list(text), self.vocabulary.own, self.vocabulary.scores
        while len(parts) > least:
            best, at = None, -1
            for k in range(len(parts) - 1):
                piece = own.get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or scores[piece] > best):
                    best, at = scores[piece], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay as they are side by side.

        The last merges of both are undone, the later one first. If a part of a's end and a part of b's beginning would
        have merged before what they were merged into otherwise, they don't stay.
        """
        key = a << 20 | b
        if key not in self.allowed:
            if len(self.allowed) > 1_000_000:
                self.allowed.clear()
            own, scores, halves, pieces = self.vocabulary.own, self.vocabulary.scores, self.halves, self.vocabulary.pieces
            x, y = pieces[a], pieces[b]
            limit, ties = -np.inf, True  # a crossing merge counts if its score is above, or with ties equal
            while True:
                joint = own.get(x + y)
                if joint is not None and (scores[joint] > limit or (ties and scores[joint] == limit)):
                    self.allowed[key] = False
                    break
                p, q = halves.get(x), halves.get(y)
                if p is None and q is None:
                    self.allowed[key] = True
                    break
                if q is None or (p is not None and scores[own[x]] < scores[own[y]]):
                    limit, ties, x = scores[own[x]], False, p[1]
                else:
                    limit, ties, y = scores[own[y]], True, q[0]
        return self.allowed[key]

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(end, piece) of every occurrence of every piece, sorted by end."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        order, ranks, packed, step = suffix_array(code, self.longest)
        padded = np.concatenate([code, np.zeros(self.longest, np.int64)])

        own = ranks[np.minimum(self.matrix, len(ranks) - 1)] * (self.matrix < len(ranks))
        bits = int(ranks.max()).bit_length()
        key, whole = np.zeros(len(own), np.int64), np.ones(len(own), bool)  # the first characters as they are packed
        for k in range(self.longest):
            whole &= (own[:, k] > 0) | (self.piece_lengths <= k)
            if k < step:
                key |= np.where(self.piece_lengths > k, own[:, k], 0) << (bits * (step - 1 - k))
        low = np.searchsorted(packed, key)
        high = np.searchsorted(packed, key + (np.int64(1) << bits * (step - np.minimum(self.piece_lengths, step))))
        high[~whole] = low[~whole]
        for depth in range(step, self.longest):  # narrow longer pieces' ranges by their next characters
            live = np.flatnonzero((self.piece_lengths > depth) & (low < high))
            if not len(live):
                break
            want = self.matrix[live, depth]
            for right in (False, True):
                a, b = low[live].copy(), high[live].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    c = padded[order[np.minimum(mid, len(order) - 1)] + depth]
                    up = open_ & ((c <= want) if right else (c < want))
                    a, b = np.where(up, mid + 1, a), np.where(open_ & ~up, mid, b)
                if right:
                    high[live] = a
                else:
                    first = a
            low[live] = first
        sizes = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        begin = order[np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(piece))]
        lengths = self.piece_lengths[piece]
        shift = 20 + self.longest.bit_length()
        both = np.sort(begin + lengths << shift | self.longest - lengths << 20 | self.piece_ids[piece])  # the longest first: it is the likeliest
        return both >> shift, both & 0xFFFFF

    def fitting(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``follows`` of each pair, by a table with a place for each hash of a pair, which the last such pair holds."""
        key = before << 20 | piece
        place = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        held = self.table[place]
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            known = self.allowed.get
            fits = [self.follows(k >> 20, k & 0xFFFFF) if (fit := known(k)) is None else fit for k in keys.tolist()]
            held[new] = (keys << 1 | np.array(fits, np.int64))[back]
            self.table[place[new]] = held[new]
        return (held & 1).astype(bool)

    def relax(self, begin: np.ndarray, lengths: np.ndarray, last: np.ndarray, first: np.ndarray, piece: np.ndarray) -> None:
        """Fill ``last`` for all those words at once, from their first characters on; ``first``: edges before each end."""
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = begin[order], lengths[order]
        for e in range(1, int(lengths.max(initial=0)) + 1):
            at = begin[: np.searchsorted(-lengths, -e, "right")] + e
            now, stop = first[at], first[at + 1]
            token = np.full(len(at), -2)
            open_ = np.flatnonzero(now < stop)
            while len(open_):
                p = piece[now[open_]]
                before = last[at[open_] - self.lengths[p]]
                fits = before < 0
                ask = np.flatnonzero(~fits)
                fits[ask] = self.fitting(before[ask], p[ask])
                token[open_[fits]] = p[fits]
                open_ = open_[~fits]
                now[open_] += 1
                open_ = open_[now[open_] < stop[open_]]
            last[at] = token

    def relax_long(self, base: int, stop: int, last: np.ndarray, first: np.ndarray, piece: np.ndarray) -> None:
        """The same for one word, character by character."""
        length, allowed = self.length, self.allowed
        found, cuts = [-1], first[base + 1 : stop + 2].tolist()
        pieces = piece[cuts[0] : cuts[-1]].tolist()
        for e in range(1, stop - base + 1):
            token = -2
            for p in pieces[cuts[e - 1] - cuts[0] : cuts[e] - cuts[0]]:
                before = found[e - length[p]]
                if before >= 0:
                    fits = allowed.get(before << 20 | p)
                    if fits is None:
                        fits = self.follows(before, p)
                    if not fits:
                        continue
                token = p
                break
            found.append(token)
        last[base : stop + 1] = found

    def ids_of(self, text: str, last: list[int]) -> bytes:
        """The ids of one word, from its last token to its first."""
        ids: list[int] = []
        e = len(text)
        while e:
            token = last[e]
            if token == -2:
                ids += [self.vocabulary.bytes[b] for b in reversed(text[e - 1].encode("utf-8", "surrogatepass"))]
                e -= 1
            else:
                ids.append(token)
                e -= self.length[token]
        return array("I", ids[::-1]).tobytes()

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of those words into the cache."""
        for i, j in text_slices(words, SLICE_CHARS):
            some = words[i:j]
            text = "\0".join(some) + "\0"
            end, piece = self.edges(text)
            first = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=len(text) + 1))])  # edges that end before
            last = np.full(len(text) + 1, -1)  # the last token of the word's encoding up to there; -1: none, -2: a character without a piece
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            begin = np.cumsum(lengths + 1) - lengths - 1
            short = lengths <= LONG_WORD
            self.relax(begin[short], lengths[short], last, first, piece)
            for k in np.flatnonzero(~short).tolist():
                self.relax_long(int(begin[k]), int(begin[k] + lengths[k]), last, first, piece)

            # All words are read off from their ends, a token of each at a time. Words with bytes are left for later.
            at, live, rounds, plain = begin + lengths, np.flatnonzero(short), [], short.copy()
            while len(live):
                token = last[at[live]]
                plain[live[token == -2]] = False
                live, token = live[token >= 0], token[token >= 0]
                rounds.append((live, token))
                at[live] -= self.lengths[token]
                live = live[at[live] > begin[live]]
            sizes = np.bincount(np.concatenate([r[0] for r in rounds]), minlength=len(some)) if rounds else np.zeros(len(some), np.int64)
            stops = np.cumsum(sizes)
            ids = np.empty(int(sizes.sum()), "<u4")
            for k, (own, token) in enumerate(rounds):
                ids[stops[own] - 1 - k] = token
            octets = ids.tobytes()
            self.words.update((w, octets[a:b]) for w, a, b in zip(some, (4 * (stops - sizes)).tolist(), (4 * stops).tolist()))
            for k in np.flatnonzero(~plain).tolist():
                self.words[some[k]] = self.ids_of(some[k], last[begin[k] : begin[k] + lengths[k] + 1].tolist())

    def split(self, text: str) -> list[str]:
        """The words: runs of spaces with the characters after them."""
        if not text:
            return []
        marked = (SPACE if self.vocabulary.prefix else "") + text.replace(" ", SPACE)
        if self.joins:
            return [marked]
        parts = marked.split(SPACE)
        words, run = [parts[0]] if parts[0] else [], 0
        if "" not in parts[1:]:
            return [*words, *map(SPACE.__add__, parts[1:])]
        for part in parts[1:]:
            run += 1
            if part:
                words.append(SPACE * run + part)
                run = 0
        return [*words, SPACE * run] if run else words

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        cut = [self.split(t) for t in texts]
        distinct = {w for ws in cut for w in ws}
        new = [w for w in distinct if w not in self.words]
        if len(self.words) + len(new) > CACHE_WORDS:
            self.old, self.words = self.words, {}
            new = list(distinct)
        if self.old:
            self.words.update((w, self.old[w]) for w in new if w in self.old)
            new = [w for w in new if w not in self.words]
        plain = [w for w in new if "\0" not in w]
        self.encode_words(plain)
        for word in set(new) - set(plain):  # the end mark itself: its bytes stand alone, no piece has them
            ids = []
            for k, part in enumerate(word.split("\0")):
                if part and part not in self.words:
                    self.encode_words([part])
                ids.append((np.array([self.vocabulary.bytes[0]], "<u4").tobytes() if k else b"") + (self.words[part] if part else b""))
            self.words[word] = b"".join(ids)
        return [b"".join(map(self.words.__getitem__, ws)) for ws in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes one after the other, spaces for marks, without the first mark."""
        if not hasattr(self, "_octets"):
            v = self.vocabulary
            number = {k: b for b, k in enumerate(v.bytes)}
            self._octets = [bytes([number[k]]) if k in number else b"" if kind == CONTROL else p.replace(SPACE, " ").encode() for k, (p, kind) in enumerate(zip(v.pieces, v.kinds))]
        text = b"".join(map(self._octets.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.prefix and text[:1] == " " else text


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return kept(path, lambda: Encoder(path))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, n_ids)`` for every row of ``docs(doc_id, text)``; ids as little-endian unsigned 32-bit bytes.

    Null and empty texts have no ids. Null ids are kept, repeated rows are encoded each, other columns are ignored, an
    empty table gives no rows. A batch's texts are taken together up to BATCH_CHARS characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in text_slices(texts, BATCH_CHARS):
                ids = own.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_ids"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(lean(run, keeps=True), "doc_id long, ids binary, n_ids long")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(doc_id, ids, ...)`` with the column ``decoded``; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            texts = [None if x is None else own.decode(np.frombuffer(x, "<u4")) for x in column]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    from pyspark.sql.types import StringType, StructType

    schema = StructType([*encoded.schema.fields])
    return encoded.mapInArrow(lean(run, keeps=True), schema.add("decoded", StringType()))
