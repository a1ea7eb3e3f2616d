"""Toxicity by a lexicon that is matched with errors, and by the context of each match."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import held_out, lean
from grainmill.plans.shared import materialise

STRIP = "\"'`.,;:!?()[]{}<>*#&%$|~^+=_-/\\«»‘’“”¿¡"
LEET = str.maketrans("013457@$", "oieastas")
QUOTES = re.compile("[\"“”„«»]")
REPORTS = frozenset("said says wrote writes quoted quote called reported sagte schrieb zitat dit dijo escribió cita".split())
KINDS = ("exact", "stem", "one", "two")
FEATURES = [f"{kind}{where}" for kind in KINDS for where in ("", "_quoted")]
CACHE = 100_000


def letters(word: str) -> str:
    return word.strip(STRIP).lower()


class Lexicon:
    """Levenshtein automata of words, intersected with a trie of terms.

    A term ending in ``*`` is a stem: it matches words that begin with it. Errors allowed: none for terms of up to four
    letters, one up to seven, two beyond. A state is a set of (trie node, errors left over); its transitions are
    computed when first taken and kept, so a word costs a look-up per letter.
    """

    def __init__(self, terms: list[str]):
        self.terms = sorted(terms)
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, bool] | None] = [None]
        self.errors: list[int] = [0]
        for term in self.terms:
            stem, name = term.endswith("*"), term.rstrip("*")
            allowed, node = (0 if len(name) <= 4 else 1 if len(name) <= 7 else 2), 0
            for c in name:
                self.errors[node] = max(self.errors[node], allowed)
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.errors.append(0)
                node = self.next[node][c]
            self.errors[node] = max(self.errors[node], allowed)
            self.ends[node] = (term, stem)
        self.alphabet = {c for edges in self.next for c in edges}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, positions: set[tuple[int, int]]) -> int:
        todo = list(positions)
        while todo:  # a letter of the term that the word lacks
            node, e = todo.pop()
            if e < self.errors[node]:
                for child in self.next[node].values():
                    if (child, e + 1) not in positions and e + 1 <= self.errors[child]:
                        positions.add((child, e + 1))
                        todo.append((child, e + 1))
        least: dict[int, int] = {}
        for node, e in positions:
            least[node] = min(e, least.get(node, 9))
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hits = [(e, self.ends[node]) for node, e in key if self.ends[node]]
            allowed = lambda term: 0 if len(term.rstrip("*")) <= 4 else 1 if len(term.rstrip("*")) <= 7 else 2
            hits = sorted((e, term, stem) for e, (term, stem) in hits if e <= allowed(term))
            self.found.append(hits or None)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if c in self.next[node]:
                after.add((self.next[node][c], e))
            if e < self.errors[node]:
                after.add((node, e + 1))  # a letter too many
                after.update((child, e + 1) for child in self.next[node].values() if e + 1 <= self.errors[child])
        return self._state(after)

    def match(self, word: str) -> tuple[str, int] | None:
        """The term with fewest errors, and their number; stems match at any of the word's beginnings."""
        state, best, alphabet = self.start, None, self.alphabet
        for c in word:
            moves = self.moves[state]
            c = c if c in alphabet else "\0"
            if c not in moves:
                moves[c] = self._move(state, c)
            state = moves[c]
            if not self.sets[state]:
                break
            for e, term, stem in self.found[state] or ():
                if stem and (best is None or e < best[1]):
                    best = (term, e)
        else:
            for e, term, stem in self.found[state] or ():
                if not stem and (best is None or e <= best[1]):
                    best = (term, e)
        return best


@dataclass
class Model:
    """Lexicon terms, words that are like them but clean, and logistic weights."""

    terms: list[str]
    clean: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    bias: float = -20.0


class Matcher(dict):
    """Word as written -> (form, term, errors), or None; at most CACHE words are kept."""

    def __init__(self, model: Model):
        self.lexicon, self.clean = Lexicon(model.terms), model.clean

    def __missing__(self, word: str):
        if len(self) >= CACHE:
            self.clear()
        form = letters(word)
        hit = self.lexicon.match(form) if len(form) >= 3 else None
        if hit is None and len(form) >= 4 and not form.isalpha():
            form = form.translate(LEET)
            hit = self.lexicon.match(form)
        found = None if hit is None or (hit[1] and form in self.clean) else (form, *hit)
        self[word] = found
        return found


def hits(text: str, matcher: Matcher, window: int = 8) -> list[tuple[str, str, int, bool]]:
    """(form, term, errors, quoted) of each match.

    A match is quoted if the ``window`` words before it, up to a line's end, open a quotation that is not closed before
    it and that closes in the window after it, or if a reporting word precedes a quotation mark there.
    """
    words = text.split()
    found = []
    for k, hit in enumerate(map(matcher.__getitem__, words)):
        if hit:
            before, after = " ".join(words[max(0, k - window) : k + 1]), " ".join(words[k : k + window + 1])
            marks = QUOTES.findall(before)
            reported = any(letters(w) in REPORTS for w in words[max(0, k - window) : k])
            quoted = (len(marks) % 2 == 1 and bool(QUOTES.search(after))) or (reported and bool(marks))
            found.append((*hit, quoted))
    return found


def features(found: list[tuple[str, str, int, bool]]) -> np.ndarray:
    """log(1 + number of matches) by kind and by quoted or not."""
    x = np.zeros(len(FEATURES))
    for _, term, errors, quoted in found:
        kind = 1 + errors if errors else int(term.endswith("*"))
        x[2 * kind + quoted] += 1
    return np.log1p(x)


def candidate_terms(text: str, toxic: bool) -> Iterator[tuple[str, int]]:
    """(term, context): words and stems of 4 to 6 letters; the context is a hash of the neighbouring words."""
    words = [letters(w) for w in text.split()]
    for k, word in enumerate(words):
        if 3 <= len(word) <= 30 and word.isalpha():
            context = hash_words(words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else "") if toxic else 0
            yield word, context
            for n in (4, 5, 6):
                if len(word) > n:
                    yield word[:n] + "*", context


def hash_words(a: str, b: str) -> int:
    import zlib

    return zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> tuple[list[float], float]:
    """Newton's method; the bias is not shrunk."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge * len(x) ** 0.5)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (p - y) + penalty * w
        w -= np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty + 1e-9), gradient)
    return w[:-1].tolist(), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, support: int = 8, precision: float = 0.95, most_terms: int = 2000) -> Model:
    """Learn terms and weights from labelled documents that are not held out.

    Bounded: at most about ``sample_rows`` labelled rows, picked by a hash of doc_id. A word or stem becomes a term if it
    stands in ``support`` different contexts of toxic documents (so that copies of one text don't make their words
    terms) and that is at least ``precision`` of its contexts and clean documents together. Words like a term that clean
    documents have are noted as clean. Weights are fitted with each half of the sample using the other's clean words.
    """
    spark = docs.sparkSession
    mine = ~held_out(F.col("doc_id"), 4)
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].alias("toxic")).where("doc_id is not null and toxic is not null").where(mine)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = int(min(1.0, sample_rows / max(n, 1)) * 1_000_000)
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).where("text is not null")
    sample = materialise(texts.join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text"), "labelled")  # the sample's bound holds

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad: set[tuple[str, int]] = set()
            good: Counter[str] = Counter()
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if toxic:
                    bad.update(candidate_terms(text, True))
                else:
                    good.update({t for t, _ in candidate_terms(text, False)})
            rows = [(t, c, 0) for t, c in bad] + [(t, -1, k) for t, k in good.items()]
            term, context, clean = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(context, pa.int64()), pa.array(clean, pa.int64())], ["term", "context", "clean"])

    counts = sample.select("toxic", "text").mapInArrow(lean(count), "term string, context long, clean long")
    counts = counts.groupBy("term", "context").agg(F.sum("clean").alias("clean"))
    counts = counts.groupBy("term").agg(F.count(F.when(F.col("context") >= 0, 1)).alias("bad"), F.sum("clean").alias("clean"))
    good_enough = (F.col("bad") >= support) & (F.col("bad") >= precision * (F.col("bad") + F.col("clean")))
    rows = counts.where(good_enough).orderBy(F.desc("bad"), "term").limit(most_terms).collect()
    terms: list[str] = []
    for term in sorted((r["term"] for r in rows), key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t)):
        if not any(term.startswith(t.rstrip("*")) for t in terms if t.endswith("*")):
            terms.append(term)
    if not terms:
        return Model([])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Model(terms))
        for batch in batches:
            found = [hits(t, matcher) for t in batch.column(2).to_pylist()]
            flat = [[[h[0], h[1], str(h[2]), str(int(h[3]))] for h in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(flat, pa.list_(pa.list_(pa.string())))], ["doc_id", "toxic", "hits"])

    seen = sample.mapInArrow(lean(look), "doc_id long, toxic int, hits array<array<string>>").collect()  # a row per sampled document
    seen.sort(key=lambda r: r["doc_id"])
    parsed = [(r["doc_id"] // 2 % 2, int(r["toxic"] > 0), [(a, b, int(e), q == "1") for a, b, e, q in r["hits"]]) for r in seen]

    def clean_words(some) -> frozenset[str]:
        bad, good = Counter(), Counter()
        for _, toxic, found in some:
            (bad if toxic else good).update({f for f, _, e, _ in found if e})
        return frozenset(f for f in good if good[f] >= 1 and good[f] >= 0.2 * bad[f])

    halves = [clean_words(p for p in parsed if p[0] != half) for half in (0, 1)]
    x = np.array([features([h for h in found if not (h[2] and h[0] in halves[half])]) for half, _, found in parsed])
    y = np.array([toxic for _, toxic, _ in parsed], float)
    weights, bias = logistic(x, y)
    return Model(terms, clean_words(parsed), weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_hits)`` for every row of ``docs(doc_id, text)``.

    Every word of the whole text is looked at. Null and empty texts have no matches and get the bias's score; a null id
    keeps its row; repeated rows are scored each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, weights = Matcher(model), np.array(model.weights)
        for batch in batches:
            scores, numbers = [], []
            for text in batch.column(1):
                found = hits(text.as_py() or "", matcher)
                z = (float(features(found) @ weights) if found else 0.0) + model.bias
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                numbers.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(numbers, pa.int32())], ["doc_id", "score", "n_hits"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(lean(run), "doc_id long, score double, n_hits int")
    return rows.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs``, all its columns, without the rows whose text scores ``threshold`` or more."""
    model = fit(docs, labels)

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, weights = Matcher(model), np.array(model.weights)
        for batch in batches:
            keep = []
            for text in batch.column("text"):
                found = hits(text.as_py() or "", matcher)
                z = (float(features(found) @ weights) if found else 0.0) + model.bias
                keep.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(verdict), docs.schema)
