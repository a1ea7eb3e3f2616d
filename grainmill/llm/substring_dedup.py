"""Passages that repeat across documents, by MinHash banding of paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import is_marked, lean, marked, text_slices
from grainmill.llm.similar import GOLD, Words, group_links, mix
from grainmill.plans.components import connected_components
from grainmill.plans.shared import materialise

REACH = 3
LEAST_LINE = 16
BANDS, ROWS = 4, 2


class Paragraphs(Words):
    """The anchors and lines of some texts at once.

    An anchor runs from one cut to the next. A word is a cut if the hash of it and the next word is the least within
    REACH words on either side; first words of lines count as smaller than all others. So cuts depend on nearby words
    only: a passage has the same anchors inside wherever it stands. Anchors have more than REACH words but at a line's
    end, where shorter ones are left out. Lines are paragraphs in the usual sense, those of LEAST_LINE words or more.
    """

    def __init__(self, texts: list[str]):
        super().__init__(texts)
        w, n, data = self.word, len(self.word), self.data
        self.chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        newline = np.concatenate([[0], np.cumsum(data == 10)])
        begins = np.diff(newline[self.start], prepend=-1) > 0
        following = np.concatenate([w[1:], np.zeros(min(n, 1), np.uint64)])
        key = mix(w * GOLD + following) | np.uint64(1 << 63)
        key = np.where(begins, key & np.uint64((1 << 63) - 1), key)
        least = np.ones(n, bool)
        for d in range(1, REACH + 1):
            if d < n:
                least[d:] &= key[d:] < key[:-d]
                least[:-d] &= key[:-d] <= key[d:]
        cuts = np.flatnonzero(least | begins)
        self.a, self.b = cuts, np.append(cuts[1:], n)[: len(cuts)]  # words of each anchor
        keep = self.b - self.a > REACH
        own = self.doc[cuts]
        self.place = (np.arange(len(cuts)) - np.searchsorted(own, own))[keep]  # the number of an anchor among its text's
        self.a, self.b = self.a[keep], self.b[keep]
        lines = np.flatnonzero(begins)
        ends = np.append(lines[1:], n)[: len(lines)]
        keep = ends - lines >= LEAST_LINE
        self.line_a, self.line_b = lines[keep], ends[keep]

    def keys(self) -> np.ndarray:
        """BANDS keys of each line, each of ROWS minima of its shingles' hashes."""
        out = np.zeros((len(self.line_a), BANDS), np.uint64)
        if not len(out):
            return out.view(np.int64)
        whole = np.append(self.shingle, np.uint64(0xFFFFFFFFFFFFFFFF))
        bounds = np.stack([self.line_a, self.line_b - 4], axis=1).ravel()
        for band in range(BANDS):
            key = np.full(len(out), np.uint64(band + 1))
            for row in range(ROWS):
                hashed = mix(whole + np.uint64((1000 + band * ROWS + row) * int(GOLD) % (1 << 64)))
                key = mix(key * np.uint64(31) + np.minimum.reduceat(hashed, bounds)[::2])
            out[:, band] = key
        return out.view(np.int64)

    def spans(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and number of characters of words a to b in their text."""
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = self.chars[self.start[a]] - self.chars[self.at[self.doc[a]]]
        return begin, self.chars[self.end[b - 1]] - self.chars[self.start[a]]

    def shingles(self, k: int) -> bytes:
        """Line k's set of shingles, as 8-byte hashes."""
        return np.unique(self.shingle[self.line_a[k] : self.line_b[k] - 4]).tobytes()


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, place, start, length, words, content, keys)`` of ``docs(doc_id, row, text)``.

    A row per anchor, with its place among the text's, and one per line, with its keys; row tells texts apart.
    """
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    names = ["doc_id", "row", "place", "start", "length", "words", "content", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for i, j in text_slices(texts, 400_000):
                p = Paragraphs(texts[i:j])
                for a, b, place, keys in ((p.a, p.b, p.place, None), (p.line_a, p.line_b, None, p.keys())):
                    start, length = p.spans(a, b)
                    doc = p.doc[a] + i
                    columns = [ids[doc], rows[doc], place, start, length, b - a, p.content(a, b)]
                    columns = [pa.nulls(len(a), t) if c is None else pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types)]
                    list_type = pa.list_(pa.int64())
                    columns.append(pa.nulls(len(a), list_type) if keys is None else pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(list_type))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "row", "text").mapInArrow(lean(run), "doc_id long, row long, place int, start int, length int, words int, content long, keys array<long>")


def near_links(docs: DataFrame, lines: DataFrame, threshold: float, most_in_key: int = 4096) -> DataFrame:
    """``(a, b)``: links by which contents of lines at a Jaccard similarity of ``threshold`` or more that meet in a band
    come into one component.

    Only keys with two different contents matter. Their contents are marked in a bitmap of bounded size, which goes to a
    second pass over the texts; that pass returns the shingles of marked lines, and a join by content undoes the
    bitmap's collisions. Then each key's contents are compared; a key with more than ``most_in_key`` is cut into blocks,
    each pair of blocks a task's work of its own.
    """
    keyed = lines.select(F.explode("keys").alias("key"), "content").distinct()
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / most_in_key).cast("int").alias("blocks"))
    candidates = materialise(keyed.join(sizes, "key"), "candidates")
    n = candidates.count()
    if not n:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    bitmap, bits = marked(candidates.select("content"), n)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for i, j in text_slices(texts, 400_000):
                p = Paragraphs(texts[i:j])
                content = p.content(p.line_a, p.line_b)
                picked = np.flatnonzero(is_marked(shared.value, content, bits))
                _, once = np.unique(content[picked], return_index=True)
                picked = picked[once]
                yield pa.RecordBatch.from_arrays([pa.array(content[picked]), pa.array([p.shingles(k) for k in picked.tolist()], pa.binary())], ["content", "shingles"])

    fetched = docs.select("text").mapInArrow(lean(fetch), "content long, shingles binary").dropDuplicates(["content"])
    return group_links(candidates.select("key", F.col("content").alias("member"), "blocks"), fetched.withColumnRenamed("content", "member"), threshold)


def repeated_passages(docs: DataFrame, threshold: float = 0.8, least_words: int = 26, bridge: int = 2) -> DataFrame:
    """Passages that stand, alike or nearly so, in two or more of ``docs(doc_id, text)``.

    A row per occurrence: doc_id, start and length (in characters), words (repeated ones in it), passage_id (its class),
    keeper_id (the smallest doc_id that has it), n_copies (occurrences), removed (true outside the keeper), near (found
    as a near copy), and row, the hash of its text. Passages are found in two ways:

    * A line (paragraph) of ``least_words`` words or more whose class has lines in two documents. Classes are the
      components of lines that meet in one of BANDS bands of ROWS minima and have a Jaccard similarity of ``threshold``
      or more over five-word shingles; at 0.8 a band pattern of 4 by 2 meets with a probability of 0.983.
    * Neighbouring anchors that stand, equal word by word (A-Z lower-cased), in other documents, with ``least_words``
      words or more together; up to ``bridge`` anchors between two with one keeper may differ, so a passage with a
      changed word stays one. Such a passage may stand anywhere in a line. Here passage_id is the smallest anchor's hash
      and n_copies the most that an anchor has.

    Of a passage some four words at each end lie in anchors that reach outside it and stay. Of passages of 51 words put
    into other texts 99.5 % have ``least_words`` in whole anchors, of 40 words some 80 %, of 32 words a quarter. Repeats inside one
    document alone are left alone. Null texts are empty; rows with a null id take no part; equal rows of one id are one
    document but count in n_copies; different texts under one id are cut each by itself and count as one document; of
    documents with the same passage the smallest id keeps it, so there are no ties; other columns are ignored; an empty
    table gives no rows.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("row"), docs["text"].alias("text")).where("doc_id is not null")
    found = materialise(paragraphs(docs), "paragraphs")
    anchors, lines = found.where("place is not null").drop("keys"), found.where("place is null")
    each = anchors.groupBy("content").agg(F.min("doc_id").alias("keeper_id"), F.max("doc_id").alias("high"), F.count("*").alias("n_copies")).where("keeper_id <> high").drop("high")
    text = ["doc_id", "row"]
    by = Window.partitionBy(*text).orderBy("place")  # a text's own anchors
    rows = anchors.join(each, "content").withColumn("before", F.lag("place").over(by)).withColumn("other", F.lag("keeper_id").over(by))
    rows = rows.where("before is null or before <> place")  # equal rows
    gap = F.col("place") - F.col("before") - 1
    breaks = F.col("before").isNull() | (gap > bridge) | ((gap > 0) & (F.col("other") != F.col("keeper_id")))
    rows = rows.withColumn("run", F.sum(breaks.cast("int")).over(by)).withColumn("removed", F.col("doc_id") != F.col("keeper_id"))
    rows = rows.withColumn("run_words", F.sum("words").over(Window.partitionBy(*text, "run"))).where(F.col("run_words") >= least_words)
    turns = F.coalesce(F.lag("removed").over(Window.partitionBy(*text, "run").orderBy("place")) != F.col("removed"), F.lit(False))
    rows = rows.withColumn("turn", turns.cast("int")).withColumn("part", F.sum("turn").over(Window.partitionBy(*text, "run").orderBy("place")))
    passages = rows.groupBy(*text, "run", "part", "removed").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("length"), F.sum("words").cast("int").alias("words"), F.min("content").alias("passage_id"), F.min("keeper_id").alias("keeper_id"), F.max("n_copies").alias("n_copies"))
    names = ["doc_id", "start", "length", "words", "passage_id", "keeper_id", "n_copies", "removed", "near", "row"]
    passages = passages.withColumn("near", F.lit(False)).select(*names)
    labels = connected_components(near_links(docs, lines.select("content", "keys"), threshold), "a", "b").select(F.col("node").alias("content"), F.col("component").alias("passage_id"))
    alike = lines.drop("keys", "place").where(F.col("words") >= least_words).join(labels, "content").distinct()
    classes = alike.groupBy("passage_id").agg(F.min("doc_id").alias("keeper_id"), F.max("doc_id").alias("high"), F.count("*").alias("n_copies")).where("keeper_id <> high").drop("high")
    near = alike.join(classes, "passage_id").withColumn("removed", F.col("doc_id") != F.col("keeper_id")).withColumn("near", F.lit(True)).select(*names)
    return passages.unionByName(near)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without those (start, length) spans and the white space after them."""
    kept, at = [], 0
    for start, length in sorted(spans):
        if start > at:
            kept.append(text[at:start])
        at = max(at, start + length)
        while at < len(text) and text[at] in " \t\n\r\v\f":
            at += 1
    kept.append(text[at:])
    return "".join(kept)


def remove_passages(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs``, all its columns, with repeated passages cut out of all texts but the keeper's.

    A row whose text has no word left is dropped; rows that nothing is cut from stay as they are, those with a null id or
    text among them. Repeated rows are cut alike and stay.
    """
    gone = repeated_passages(docs, threshold).where("removed").distinct()
    spans = gone.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "length")).alias("_spans"))  # bounded by a text
    spans = spans.withColumnsRenamed({"doc_id": "_doc_id", "row": "_row"})
    names = docs.columns
    joined = docs.join(spans, (docs["doc_id"] == spans["_doc_id"]) & (F.xxhash64(docs["text"]) == spans["_row"]), "left").select(*(docs[n] for n in names), "_spans")
    text = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for t, spans_ in zip(batch.column(text), batch.column(batch.num_columns - 1)):
                t, pieces = t.as_py(), spans_.as_py()
                if pieces:
                    t = cut(t, [(p["start"], p["length"]) for p in pieces])
                texts.append(t)
                keep.append(not pieces or bool(t.strip()))
            columns = [batch.column(k) if k != text else pa.array(texts, batch.column(k).type) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(lean(run), docs.schema)
