"""What several operators share: reading columns by name, word units and tokenizers, crc32 of ids."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.plans.shared import is_marked, marked  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
CACHE_WORDS = 100_000
SEEN = 1 << 20
SLICE_BYTES = 16_000_000
LONG = 1_000_000
JOINED = 1 << 18
MARKS = "".join(map(chr, [*range(33, 39), *range(40, 48), 58, 59, 61, 63, 64, *range(91, 97), 123, 125, 126]))  # no token joins them to letters
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column, folds: int, fold: int = 2) -> Column:
    """True for rows whose crc32 of the id's decimal text leaves ``fold``; a null id is taken as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def only(df: DataFrame, *names: str) -> DataFrame:
    """Those columns and no others, so that extra columns can't clash with an operator's own."""
    return df.select(*(df[n] for n in names))


EXOTIC_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class _Units(dict):
    """Unit of text, after ``lead`` -> its ids as little-endian unsigned 32-bit bytes."""

    latin_letters = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
    latin = re.compile(latin_letters).fullmatch

    def __init__(self, tokenizer, lead: str, keeps_space: bool):
        self.tokenizer, self.model, self.lead, self.keeps_space = tokenizer, tokenizer.model, lead, keeps_space
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.shown_lead, self.tokenize = lead.translate(self.table), self.model.tokenize
        self.newline = self.direct("\n")
        self.old: dict[str, bytes] = {}
        self.room, self.seen = CACHE_WORDS, bytearray(SEEN)
        self.bare = _Units(tokenizer, "", keeps_space) if lead else self

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, text: str) -> bytes:
        if not self.keeps_space:
            text = text.lower()
        spelled = self.shown_lead + text if text.isascii() else (self.lead + text).encode().decode("latin1").translate(self.table)
        ids = [t.id for t in self.tokenize(spelled)]
        try:
            return PACK[len(ids)](*ids)
        except IndexError:
            return np.array(ids, "<u4").tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            word = unit.rstrip(MARKS)
            if word.isalpha() and (word.isascii() or self.latin(word)):
                ids = self.word(word) if word == unit else self[word] + self.bare[unit[len(word) :]]
            elif "\n" in unit and all(p and not p[0].isspace() and not p[-1].isspace() for p in unit.split("\n")):
                first, *others = unit.split("\n")
                return self.newline.join([self[first], *(self.bare[p] for p in others)])  # seldom seen again
            else:
                ids = self.direct(self.lead + unit)
            seen, at = self.seen, hash(unit) & SEEN - 1
            if not seen[at]:  # most new units don't come again: they are kept from the second time on
                seen[at] = 1
                return ids
        self.room -= 1
        if self.room < 0:
            self.room, self.old = CACHE_WORDS, dict(self)
            self.clear()
            self.seen = bytearray(SEEN)
        self[unit] = ids
        return ids


class UnitTokenizer:
    """A byte-level tokenizer of the tokenizers library that encodes each distinct word once.

    A text is cut before single spaces between two characters that are not white space. For byte-level BPE (a
    word takes the space before it along) and for word BPE (white space is dropped) no token crosses such a cut,
    so the ids of the pieces, one after the other, are the ids of the text. Words of Latin letters go straight to
    the library's BPE model, anything else through its whole encoder; tests compare both with whole texts. The
    cache holds two generations of at most CACHE_WORDS words; a full one replaces the older.
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.cache = _Units(Tokenizer.from_file(path), " " if keeps_space else "", keeps_space)
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.odd = rf"  | \n|\n | \z|[{EXOTIC_SPACE}]"  # texts that can't be cut before every space

    def units(self, text: str) -> list[str]:
        if "  " in text or " \n" in text or "\n " in text or text[-1:] == " " or any(map(text.__contains__, EXOTIC_SPACE)):
            return self.cut.split(text)
        return text.split(" ")

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit bytes; long texts go by slices of about LONG characters."""
        if not self.cache.keeps_space and text.isascii():
            text = text.lower()  # as the library does, so that a word is met in one spelling
        ids, start, cache = [], 0, self.cache.bare
        while len(text) - start > 2 * LONG and (m := self.cut.search(text, start + LONG)):
            first, *others = self.units(text[start : m.start()])
            ids += [cache[first], *map(self.cache.__getitem__, others)]
            start, cache = m.end(), self.cache
        first, *others = self.units(text[start:])
        return b"".join([*ids, cache[first], *map(self.cache.__getitem__, others)])

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` of each text; a unit is looked up once for all texts of about SLICE_BYTES."""
        for i, j in array_slices(texts, SLICE_BYTES):
            yield from self._encode_slice(texts.slice(i, j - i).fill_null(""))

    def _encode_slice(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.greater(pc.binary_length(texts), 2 * LONG)
        if self.cache.keeps_space:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.odd))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        if self.cache.keeps_space:
            cut = pc.split_pattern(plain, " ")
        else:  # as ``encode`` does; all white space is dropped, so each is cut at
            ascii_ = pc.equal(pc.binary_length(plain), pc.utf8_length(plain))
            cut = pc.ascii_split_whitespace(pc.if_else(ascii_, pc.ascii_lower(plain), plain))
        places, units = cut.offsets.to_numpy(), cut.values
        first = units.take(pa.array(places[:-1])).to_pylist()  # has no space before it
        units = units.dictionary_encode()

        # Latin words and the marks at their ends are looked up apart, as ``_Units`` does.
        names = units.dictionary
        word = pc.utf8_rtrim(names, characters=MARKS)
        apart = pc.and_(pc.match_substring_regex(word, rf"\A{_Units.latin_letters}\z"), pc.not_equal(word, names))
        sizes = pc.utf8_length(word).filter(apart).to_pylist()
        marks = pa.array([n[k:] for n, k in zip(names.filter(apart).to_pylist(), sizes)], pa.string()).dictionary_encode()
        words = pc.if_else(apart, word, names).dictionary_encode()
        ids = [*map(self.cache.bare.__getitem__, first), *map(self.cache.__getitem__, words.dictionary.to_pylist())]
        ids += [*map(self.cache.bare.__getitem__, marks.dictionary.to_pylist()), b""]
        ends = np.full(len(names), len(ids) - 1, np.int32)
        ends[apart.to_numpy(zero_copy_only=False)] = len(first) + len(words.dictionary) + marks.indices.to_numpy()
        found = pa.array(ids, pa.large_binary())
        both = pc.binary_join_element_wise(found.take(pa.array(words.indices.to_numpy() + np.int32(len(first)))), found.take(pa.array(ends)), pa.scalar(b"", found.type))
        found, at = pa.concat_arrays([found.slice(0, len(first)), both]), units.indices.to_numpy() + np.int32(len(first))
        at[places[:-1]] = np.arange(len(first))
        del plain, cut, units, names, word, words, ids, both  # only what the texts need is held while they are yielded

        done = _joined(found, at, places)
        for k, other in enumerate(odd.tolist()):
            yield self.encode(texts[k].as_py()) if other else next(done)


def _joined(found: pa.Array, at: np.ndarray, places: np.ndarray) -> Iterator[bytes]:
    """For each text, the octets of its units ``found[at]`` one after the other; at most about JOINED units at a time."""
    i, last = 0, len(places) - 1
    while i < last:
        j = max(i + 1, int(np.searchsorted(places, places[i] + JOINED, "right")) - 1)
        some = found.take(pa.array(at[places[i] : places[j]]))
        cuts, octets = np.frombuffer(some.buffers()[1], np.int64)[places[i : j + 1] - places[i]].tolist(), memoryview(some.buffers()[2] or b"")
        for begin, end in zip(cuts, cuts[1:]):
            yield bytes(octets[begin:end])
        i = j


_KEPT: dict = {}


def kept(key, make: Callable):
    """A thing that this Python worker keeps for its next task; what it kept for another purpose is let go first."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Let go of what the worker keeps, and give freed memory back to the system."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps freed memory in its own way
        pass


def lean(run: Callable, keeps: bool = False) -> Callable:
    """A partition function whose task starts without what other operators left in the worker, and gives memory back.

    Workers outlive their tasks and serve several operators, so what each leaves would add up. ``keeps``: the function
    asks ``kept`` for things itself.
    """

    def wrapped(batches: Iterator) -> Iterator:
        if not keeps:
            release()
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def unit_tokenizer(path: str, keeps_space: bool) -> UnitTokenizer:
    """One tokenizer per Python worker."""
    return kept((path, keeps_space), lambda: UnitTokenizer(path, keeps_space))


def text_slices(texts: list[str], most_bytes: int = 4_000_000):
    """(from, to) ranges of texts with at most about ``most_bytes`` characters each, so that memory is bounded."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most_bytes:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def array_slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """The same for an Arrow array, by bytes; a range has at most that many, or one text."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most_bytes, "right")))
        yield start, stop
        start = stop
