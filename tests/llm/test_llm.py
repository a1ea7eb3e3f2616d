"""The pipeline's operators against brute force, the libraries, and odd tables."""

import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from grainmill.llm import ann, language_model, packing, pivots, sentencepiece, simhash, substring_dedup, token_store, toxicity, url_filter
from grainmill.llm import common
from grainmill.llm.common import array_slices, tokenizer_path, unit_tokenizer

DOCS = "doc_id long, text string, ids string, score int, fingerprint string"
ODD = [(1, None, "x", 1, "y"), (None, "a text without an id", "x", 1, "y"), (2, "", None, None, None), (3, "same words here", "x", 1, "y"), (3, "same words here", "x", 1, "y"), (4, "word " * 3000, "x", 1, "y"), (5, " \n\t ", "x", 1, "y"), (6, "Ünïcödé  日本語 \x00 😀 <|endoftext|>", "x", 1, "y")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) + rng.choice(["", "", ",", ".\n", ". "]) for _ in range(n))


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_give_the_librarys_ids(name, keeps):
    rng = random.Random(2)
    texts = [prose(rng, 200) for _ in range(20)] + [t for _, t, *_ in ODD if t] + ["", " ", "a  b", "a \nb", "a\n \nb ", "it's 'll", "\x1c \x1d a", "é ́b", "İ Σας", "\nA\n\nb\n", "x '\ny"]
    own, library = unit_tokenizer(tokenizer_path(name), keeps), Tokenizer.from_file(tokenizer_path(name))
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("most", [8_000_000, 300, 1])
def test_units_of_many_texts_are_looked_up_once(name, keeps, most, monkeypatch):
    rng = random.Random(5)
    texts = [prose(rng, 100) for _ in range(20)] + [t for _, t, *_ in ODD] + ["", " ", " a", "a ", "a  b", "a \nb", "a\n b", "A\tB c", "x\u3000y z", "x\x85y", "É A é", "I\u0307 İ A\u0301", "a|b | c", "same Same SAME", None, "\n", "x\n"]
    monkeypatch.setattr(common, "SLICE_BYTES", most)
    library, own = Tokenizer.from_file(tokenizer_path(name)), common.UnitTokenizer(tokenizer_path(name), keeps)
    for a in (pa.array(texts), pa.array(texts).slice(3, 30), pa.array([], pa.string()), pa.array(["  ", "\t"])):
        for text, ids in zip(a.to_pylist(), own.encode_all(a), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    if most > 1000:
        asked, own = [], common.UnitTokenizer(tokenizer_path(name), keeps)
        own.cache.__class__ = type("Counted", (type(own.cache),), {"__getitem__": lambda d, k: asked.append(k) or super(type(d), d).__getitem__(k)})
        list(own.encode_all(pa.array(["one two three two"] * 500)))
        assert len(asked) <= 500 + 10  # beyond first words, whatever the number of texts


def check_pieces(rows, docs, size):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[doc_id], key=lambda r: r["start"])
        assert [x for p in pieces for x in np.frombuffer(p["ids"], "<u4").tolist()] == ids
        assert all(p["doc_tokens"] == len(ids) for p in pieces)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
    return by_sequence


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(4)
    docs = [(k, prose(rng, rng.randrange(0, 400))) for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    rows = packing.pack(frame, tokenizer_path("byte_bpe_50k.json"), size=128, most_open=4, fan_in=2).collect()
    sequences = check_pieces(rows, docs, 128)
    assert sum(sum(p["length"] for p in s) < 128 for s in sequences.values()) <= 1


def test_packing_odd(spark, odd, empty):
    rows = packing.pack(odd, tokenizer_path("byte_bpe_50k.json")).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1 and any(r["doc_id"] is None for r in rows)
    assert packing.pack(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_packing_looks_words_up_once_for_many_texts():
    path = tokenizer_path("byte_bpe_50k.json")
    asked, own = [], common.UnitTokenizer(path, True)
    own.cache.__class__ = type("Counted", (type(own.cache),), {"__getitem__": lambda d, k: asked.append(k) or super(type(d), d).__getitem__(k)})
    texts = ["one two three two", None, "", "four  five\n"] * 200
    batches = [pa.RecordBatch.from_pydict({"doc_id": [*range(k, k + 400)], "text": texts[k : k + 400]}) for k in (0, 400)]
    fields = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"]
    rows = [dict(zip(fields, r)) for r in packing._pieces(iter(batches), own, bytes(4), packing.Windows(64, 4, 0))]
    check_pieces(rows, enumerate(texts), 64)
    assert sum(k in ("two", "three") for k in asked) <= 2 * len(batches)  # of 600 in these texts


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("most", [1, 5, 150, 1 << 18])
def test_units_are_joined_by_groups_of_texts(name, keeps, most, monkeypatch):
    rng = random.Random(6)
    texts = ["", *(prose(rng, rng.randrange(40)) for _ in range(60)), "a  b", None, "x (y), z!", "", "(z)! x", " ", "end"]
    monkeypatch.setattr(common, "JOINED", most)
    library, own = Tokenizer.from_file(tokenizer_path(name)), common.UnitTokenizer(tokenizer_path(name), keeps)
    for text, ids in zip(texts, own.encode_all(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_store_round_trip(spark, odd, empty, planes):
    shards = token_store.write_tokens(odd, tokenizer_path("word_bpe_49k.json"), planes=planes, partitions=3)
    rows = sorted(token_store.read_tokens(shards).collect(), key=lambda r: r["start"])
    library, at = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), 0
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (doc_id, text, *_) in zip(rows, order, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (doc_id, at, ids)
        at += len(ids)
    assert token_store.read_tokens(token_store.write_tokens(empty, tokenizer_path("word_bpe_49k.json"))).count() == 0


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("hot", [4096, 4])
def test_simhash_links_against_all_pairs(spark, hot):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(15)})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    expected = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4}
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), 4, hot).collect()
    assert {tuple(sorted((r["a"], r["b"]))) for r in found} == expected


def test_simhash_fingerprint_by_hand():
    words = b"one two three four five six two three four five".split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(7)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 7)
    own = simhash.majority(simhash.shingle_hashes("ONE two\tthree four  five\nsix two three four five", 4))
    assert own % (1 << 64) == bits


def test_simhash_odd(spark, odd, empty):
    rows = simhash.near_duplicates(odd, 4, 4).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["fingerprint"] == 0} == {1}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns


def test_substring_dedup_finds_planted_passages(spark):
    rng = random.Random(8)
    passage = prose(rng, 60)
    texts = [prose(rng, 150) for _ in range(40)]
    planted = [3, 11, 25]
    for k in planted:
        words = texts[k].split(" ")
        texts[k] = " ".join([*words[: 20 + k], passage, *words[20 + k :]])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = substring_dedup.repeated_passages(frame).collect()
    assert {r["doc_id"] for r in rows} == set(planted)
    assert {r["doc_id"] for r in rows if r["removed"]} == {11, 25}
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(frame).collect()}
    assert all(cut[k] == texts[k] for k in range(40) if k not in (11, 25)) and passage not in cut[11]


def test_substring_dedup_odd(spark, odd, empty):
    assert substring_dedup.repeated_passages(odd).count() == 0
    assert substring_dedup.remove_passages(odd).count() == len(ODD)
    assert substring_dedup.repeated_passages(empty).count() == 0


VECTORS = "vec_id long, embedding array<float>, score double"


def vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 16)).astype(np.float32)
    v[50:80] = v[10] + 0.05 * rng.standard_normal((30, 16))
    v[90:100] = v[20]
    rows = [(k, x.tolist(), 0.0) for k, x in enumerate(v)] + [(900, None, 0.0), (901, [0.0] * 16, 0.0), (902, [float("nan")] * 16, 0.0), (903, [1.0, None] * 8, 0.0), (904, [1.0], 0.0), (None, [1.0] * 16, 0.0)]
    return v.astype(float), spark.createDataFrame(rows, VECTORS)


def test_pivots_against_all_pairs(spark):
    v, frame = vectors(spark)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    of = components(len(v), zip(*np.nonzero(near)))
    found = {r["vec_id"]: r for r in pivots.near_duplicate_vectors(frame).collect()}
    assert len(found) == 406 and found[None]["kept"] and found[901]["n_links"] == 0 and found[902]["component_id"] == 902
    assert all(found[k]["n_links"] == near[k].sum() and found[k]["component_id"] == of[k] for k in range(len(v)))
    assert pivots.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_pivot_lists_in_blocks(spark):
    v, frame = vectors(spark)
    reps = pivots.valid_vectors(frame).dropDuplicates(["vector"])
    whole = {tuple(r) for r in pivots.vector_links(reps, 400).collect()}
    assert whole == {tuple(r) for r in pivots.vector_links(reps, 400, most_in_list=16).collect()}


@pytest.mark.parametrize("most", [65_536, 7])
def test_ann_recall(spark, most):
    v, frame = vectors(spark)
    rows = ann.search(frame, every=20, most_in_block=most, most_queries=max(2, most // 3)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r)
    hits = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(v)), d))[:10].tolist()
        assert [r["rank"] for r in by[q]] == list(range(1, 11)) and all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in by[q])
        hits += len({r["vec_id"] for r in by[q]} & set(best))
    assert hits >= 0.9 * 200
    assert ann.search(spark.createDataFrame([], VECTORS)).count() == 0


def test_sentencepiece_is_the_librarys(spark, odd, empty):
    import sentencepiece as library

    path = tokenizer_path("piece_bpe_32k.model")
    model, own, rng = library.SentencePieceProcessor(model_file=path), sentencepiece.Encoder(path), random.Random(9)
    texts = [prose(rng, 100) for _ in range(20)] + ["", "  ", " a", "a  b ", "<s> </s> <unk> <0x41>", "日本語 é", "▁x ▁▁ y", "\0a\0 b", "aaaaaaaaaaaa", "=" * 99, "\n\n\n", "😀"]
    for text, ids in zip(texts, own.encode(texts)):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == model.encode(text), text
        assert own.decode(ids) == model.decode(ids.tolist())
    both = sentencepiece.decode_documents(sentencepiece.encode_documents(odd, path), path)
    assert sorted(r["decoded"] for r in both.collect()) == sorted(t or "" for _, t, *_ in ODD)
    assert sentencepiece.encode_documents(empty, path).count() == 0


def test_sentencepiece_relaxes_words_together():
    import sentencepiece as library

    path = tokenizer_path("piece_bpe_32k.model")
    model, own, rng = library.SentencePieceProcessor(model_file=path), sentencepiece.Encoder(path), random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéЖд.,\n日😀\ud7ff"
    long = ["x".join(rng.choices(letters, k=n)) for n in (31, 32, 33, 34, 500)] + ["a" * n for n in (62, 63, 64, 65, 66, 3000)]
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 14))) for _ in range(4000)] + long
    text = " ".join(words)
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == model.encode(text)
    assert all(np.frombuffer(i, "<u4").tolist() == model.encode(w) for w, i in zip(long, own.encode(long)))
    plain = [sentencepiece.SPACE + "".join(rng.choices("abcdefghijklmnopqrst", k=9)) for _ in range(4000)]
    own.encode_words(plain)  # all pairs of pieces have been looked up
    own.words.clear()
    lines = 0

    def trace(frame, event, _):
        nonlocal lines
        lines += event == "line"
        return trace

    sys.settrace(trace)
    own.encode_words(plain)
    sys.settrace(None)
    assert lines < 10 * len(plain)  # lines of Python that ran; over 100 a word when each is relaxed by itself


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row


def test_levenshtein_automaton_against_the_table():
    rng = random.Random(7)
    terms = ["idiot", "worthless", "scum", "disgusting", "lostr*", "vequx*"]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(2000):
        word = list(rng.choice(terms).rstrip("*") + rng.choice(["", "en", "a"]))
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randrange(0, 2)] = rng.choice(["", "x", "s", "o"])
        word = "".join(word)
        best = None
        for t in terms:
            name = t.rstrip("*")
            allowed = 0 if len(name) <= 4 else 1 if len(name) <= 7 else 2
            table = distance(name, word)
            d = min(table) if t.endswith("*") else table[-1]
            if d <= allowed and (best is None or d < best):
                best = d
        hit = lexicon.match(word)
        assert (hit[1] if hit else None) == best, word


def toxic_table(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for k in range(600):
        words, bad = prose(rng, 40).split(" "), k % 5 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "Idiot!", "worthless"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_held_out_accuracy(spark, odd, empty):
    docs, labels, truth = toxic_table(spark)
    model = toxicity.fit(docs, labels)
    rows = [r for r in toxicity.score(docs, model).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.95
    odd_rows = toxicity.score(odd, model).collect()
    assert len(odd_rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd_rows)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(empty, labels.where("false")).terms == []
    assert toxicity.hits('they wrote "you idiot" there', toxicity.Matcher(toxicity.Model(["idiot"])))[0][3]


def test_language_model_is_a_distribution_and_its_base_is_exact(spark, odd, empty):
    rng = random.Random(11)
    texts = [(k, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "rare%d" % rng.randrange(40)], k=rng.randrange(0, 60)))) for k in range(150)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language_model.score_documents(frame, head=20, hidden=8, known_words=30).collect()}
    words = {k: language_model.words_of(t) for k, t in texts}
    counts = {}
    for k, ws in words.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for k, ws in words.items():
        base = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws)
        assert abs(rows[k]["base_score"] - base) < 1e-9 and rows[k]["n_known"] == sum(w in counts for w in ws) and rows[k]["train_tokens"] == n
    assert len(language_model.score_documents(odd).collect()) == len(ODD)
    assert language_model.score_documents(empty).count() == 0
    vocabulary = language_model.Vocabulary.of(spark.createDataFrame([(w, c, language_model.tail_of(w)) for w, c in counts.items()], "word binary, n long, tail int"), 20)
    model = language_model.Model(vocabulary, 8)
    model.ready()
    h = np.random.default_rng(0).uniform(-1, 1, (5, 8)).astype(np.float32)
    total = sum(np.exp(model.log_probability(h, np.full(5, y))) for y in range(model.symbols))
    assert np.allclose(total, 1, atol=1e-4)
    assert np.allclose(model.infer(np.arange(5), h), model.step(np.arange(5), h)[0], atol=1e-5)
    assert np.allclose(model.log_probability(h, np.arange(5)), model.outputs(h, np.arange(5)), atol=1e-4)


def test_language_model_trains_on_every_document(spark):
    rng = random.Random(13)
    texts = [(k, " ".join(rng.choices(["one", "two", "three"], k=40))) for k in range(400)]
    late = [(1000 + k, " ".join(["one two three"] * 14)) for k in range(400)]
    frame = spark.createDataFrame(texts + late, "doc_id long, text string").repartition(5)
    counts = language_model.word_counts(frame)
    vocabulary = language_model.Vocabulary.of(counts, 10)
    models = [language_model.fit(frame, vocabulary, 8, warm_tokens=most) for most in (100, 1_000_000)]
    assert [m.trained_tokens for m in models] == [vocabulary.tokens] * 2  # beyond the start's tokens as below them
    ids = [[language_model.Encoder(vocabulary)[w] for w in language_model.words_of(t)] for _, t in late[:20]]
    scores = [language_model.score_batch(m, [np.array(x, np.int32) for x in ids]).sum() for m in models]
    unigram = sum(np.log10(vocabulary.counts[i].sum() / vocabulary.tokens) for x in ids for i in x)
    assert min(scores) > unigram
    seen = []
    model = language_model.Model(vocabulary, 8)
    model.end = 0
    model.train_window, whole = lambda x, y, h, run=model.train_window: (seen.append(x), run(x, y, h))[1], [np.arange(k, k + 50, dtype="<i4") % 4 for k in range(9)]
    assert language_model.train_all(model, iter([whole]), language_model.fresh_memory(model), chunk=200) == 450 and sum(x.size for x in seen) >= 450 - 3 * 3


def test_urls(spark):
    rows = [(1, "http://A.Example.ORG/es/1?x", ""), (2, "https://b.example.org/en/12", None), (3, "x://c.com/fr/", ""), (4, None, ""), (5, "no scheme", ""), (6, "http://bad.com/de/1", ""), (7, "http://bad.com/xx", ""), (8, "http://linker.net/", '<a href="http://bad.com/de/9">x</a>'), (9, "http://org", "")]
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert found[2] == ("b.example.org", "/en/12", "example.org/en/1", "block")
    assert found[3] == ("c.com", "/fr/", "com/fr/", "allow")
    assert found[4] == ("", "", None, "allow") == found[5]
    assert found[7] == ("bad.com", "/xx", None, "block") and found[8] == ("linker.net", "/", None, "block")
    assert found[9] == ("org", "", None, "allow")


def test_distrust_reaches_the_end_of_a_chain(spark):
    seeds = spark.createDataFrame([("h0", False, True)], "host string, trusted boolean, blocked boolean")
    edges = spark.createDataFrame([(f"h{k + 1}", f"h{k}", 1) for k in range(12)], "src string, dst string, weight long")
    found = {r["host"]: r["distrust"] for r in url_filter.host_trust(seeds, edges).collect()}
    assert all(abs(found[f"h{k}"] - 0.15 * 0.85**k) < 1e-8 for k in range(13))


def test_ann_with_repeated_ids(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 8))
    rows = [(k, x.tolist(), 1.0) for k, x in enumerate(v)]
    rows += [rows[7], rows[7], (7, v[0].tolist(), 1.0), (9, None, 1.0)]  # equal rows, and one id under two vectors
    found = [(r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double"), k=10).where("query_id = 0").orderBy("rank").collect()]
    d = {k: float(np.linalg.norm(v[k] - v[0])) for k in range(1, 60)} | {7: 0.0}
    assert found == [(n + 1, k, round(d[k], 9)) for n, k in enumerate(sorted(d, key=lambda k: (d[k], k))[:10])]


def test_very_long_texts_are_packed_and_stored(spark):
    rng = random.Random(20)
    text = " ".join(prose(rng, 2000) for _ in range(170))
    assert len(text) > 2_000_000
    frame = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")
    for name, end in (("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 2)):
        ids = np.array([*Tokenizer.from_file(tokenizer_path(name)).encode(text, add_special_tokens=False).ids, end], "<u4")
        if end:
            stored = token_store.read_tokens(token_store.write_tokens(frame, tokenizer_path(name))).where("doc_id = 1").first()
            assert bytes(stored["ids"]) == ids.tobytes() and stored["start"] == 0
        else:
            pieces = packing.pack(frame, tokenizer_path(name)).where("doc_id = 1").orderBy("start").collect()
            assert b"".join(bytes(p["ids"]) for p in pieces) == ids.tobytes()


def test_language_model_reads_texts_twice(spark):
    rng = random.Random(17)
    frame = spark.createDataFrame([(k, prose(rng, 30)) for k in range(200)], "doc_id long, text string")
    rows = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    assert language_model.score_documents(frame.mapInArrow(count, "doc_id long, text string"), head=20, hidden=8).count() == 200
    assert 0 < rows.value <= 2 * 200  # once to count words, once to turn them into symbols; it was once a round too


def test_words_in_texts_are_those_of_each():
    texts = [t for _, t, *_ in ODD] + ["", " ", "a", " A\tb\x0bC\x0c\r\n", "x\x1cy\x85z\xa0w\u2003v", "İ ÀÉ ẞ", "\x00 \x00", "a  b   c", None, "Z" * 50]
    array = pa.array(texts, pa.string())
    assert [x for i, j in array_slices(array, 20) for x in array.slice(i, j - i).to_pylist()] == texts
    for a in (array, array.slice(2, 11), array.slice(0, 0)):
        words, sizes = language_model.words_in(a)
        assert words.to_pylist() == [w for t in a.to_pylist() for w in language_model.words_of(t)]
        assert sizes.tolist() == [len(language_model.words_of(t)) for t in a.to_pylist()]


def test_a_score_is_that_of_the_document_alone(spark):
    rng = random.Random(21)
    texts = [prose(rng, n) for n in (0, 1, 5, 40, 700, 3)] * 3
    counts = language_model.word_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    vocabulary = language_model.Vocabulary.of(counts, 60)
    model = language_model.Model(vocabulary, 8)
    encoder = language_model.Encoder(vocabulary)
    symbols = [np.fromiter(map(encoder.__getitem__, language_model.words_of(t)), np.int32) for t in texts]
    together = language_model.score_batch(model, symbols, most_lanes=4, steps=7)
    for ids, got in zip(symbols, together):
        h, x, total = np.zeros((1, 8), np.float32), model.symbols, 0.0
        for y in ids:
            h = model.step(np.array([x]), h)[0]
            total += float(model.outputs(h, np.array([y]))[0])
            x = y
        assert abs(total / np.log(10) - got) < 1e-3 * max(1, len(ids) / 20)


def test_frequent_words_are_bounded(spark):
    rows = [(b"w%d" % k, n, 0) for k, n in enumerate([500, 400, 300] + [7] * 2000)]
    counts = spark.createDataFrame(rows, "word binary, n long, tail int")
    assert {r["n"] for r in language_model.frequent_words(counts, 3).collect()} == {500, 400, 300}
    some = language_model.frequent_words(counts, 203).collect()
    assert 150 <= len(some) <= 240 and sum(r["n"] > 7 for r in some) == 3
    assert language_model.frequent_words(counts, 5000).count() == 2003
