"""Near copies and repeated passages against all pairs, hot groups, repeated rows."""

import random
import re
import time

import numpy as np

from grainmill.llm import simhash, substring_dedup
from grainmill.llm.similar import Union, Words, similar_links

LETTERS = "abcdefghijklmnop"


def prose(rng, n):
    return " ".join("".join(rng.choices(LETTERS, k=rng.randint(3, 8))) for _ in range(n))


def changed(rng, text, share):
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in text.split(" "))


def runs(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def components(n, links):
    union = Union()
    for a, b in links:
        union.join(a, b)
    least = {}
    for k in range(n):
        root = union.find(k)
        least[root] = min(k, least.get(root, k))
    return [least[union.find(k)] for k in range(n)]


def alike(sets, threshold=0.8):
    return [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]


def test_links_join_the_components_of_all_pairs():
    rng = np.random.default_rng(1)
    base = [rng.choice(400, 30, replace=False) for _ in range(15)]
    sets = [np.unique(np.where(rng.random(30) < 0.07, rng.integers(0, 400, 30), b)).astype(np.uint64) for b in base for _ in range(6)]
    pairs = alike([set(s.tolist()) for s in sets])
    found = list(similar_links(sets, 0.8))
    assert set(found) <= set(pairs) and components(len(sets), found) == components(len(sets), pairs)
    side = [k % 2 for k in range(len(sets))]
    own = [[(i, j) for i, j in similar_links([sets[k] for k in range(h, len(sets), 2)], 0.8)] for h in (0, 1)]
    split = [(2 * i + h, 2 * j + h) for h in (0, 1) for i, j in own[h]] + list(similar_links(sets, 0.8, side))
    assert components(len(sets), split) == components(len(sets), pairs)


def test_a_hot_group_gives_as_many_links_as_members():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 60)
    sets = [np.unique(np.append(base, rng.integers(0, 1 << 60, 3))).astype(np.uint64) for _ in range(20_000)]
    began = time.time()
    assert len(list(similar_links(sets, 0.8))) == len(sets) - 1
    assert time.time() - began < 60


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(5)
    base = [prose(rng, rng.choice([4, 40, 200, 700])) for _ in range(60)]
    texts = base + [changed(rng, rng.choice(base), rng.choice([0.0, 0.01, 0.02, 0.05])) for _ in range(240)]
    texts += ["a repeated line of eight words stands here\n" * 40 + prose(rng, 60) for _ in range(4)]  # alike but for the line
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [runs(t) for t in texts]
    pairs = alike(sets)
    found = {r["doc_id"]: r["keeper"] for r in simhash.similar_documents(frame).collect()}
    expected = components(len(texts), pairs)
    assert len(found) == len(texts)
    same = sum(found[i] == found[j] for i, j in pairs)
    assert same >= 0.95 * len(pairs)
    assert all(expected[k] == expected[found[k]] for k in found)  # nothing else is joined
    assert {found[k] for k in range(300, 304)} == {300, 301, 302, 303}
    kept = {r["doc_id"] for r in simhash.keep_one(frame).collect()}
    assert kept == {k for k in found if found[k] == k}
    blocks = {r["doc_id"]: r["keeper"] for r in simhash.similar_documents(frame, most_in_group=2).collect()}
    assert blocks == found


def test_near_copies_odd(spark):
    rng = random.Random(6)
    one, other = prose(rng, 80), prose(rng, 80)
    rows = [(None, one), (1, None), (2, ""), (3, one), (3, one), (4, one), (5, other), (5, one), (6, " \n"), (7, other.upper())]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, keeper string")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(None, one), (1, None), (2, ""), (3, one), (3, one), (5, other), (6, " \n")], key=str)
    assert simhash.keep_one(frame.limit(0)).count() == 0


def test_layout_finds_what_it_says():
    rng = np.random.default_rng(3)
    for n in (1000, 1 << 24, 1 << 30):
        count, width = simhash.layout(n)
        met = 0
        for _ in range(150):
            both, own = rng.integers(0, 1 << 63, 240).astype(np.uint64), rng.integers(0, 1 << 63, 60).astype(np.uint64)
            x, y = (np.unpackbits(np.frombuffer(simhash.set_print(np.unique(np.append(both, o)), count * width), np.uint8)).reshape(count, width) for o in (own[:30], own[30:]))
            met += bool(((x ^ y).sum(1) <= 1).any())
        assert met >= 0.85 * 150


def test_big_buckets_are_joined_like_small_ones():
    rng = np.random.default_rng(4)
    u = rng.integers(0, 1 << 63, (5, 2)).astype(np.uint64)[rng.integers(0, 5, 1500)] ^ (np.uint64(1) << rng.integers(0, 63, (1500, 2)).astype(np.uint64))
    ids, starts, sizes = np.arange(1500), np.array([0]), np.array([1500])
    pairs = [(a, b) for x, y in simhash._paired(ids, u, starts, sizes, 8) for a, b in zip(x.tolist(), y.tolist())]
    whole = [(a, b) for x, y in simhash._paired(ids, u, starts, sizes, 8, small=2000) for a, b in zip(x.tolist(), y.tolist())]
    assert components(1500, pairs) == components(1500, whole) and len(set(components(1500, pairs))) == 5


def test_anchors_do_not_depend_on_what_stands_around():
    rng = random.Random(9)
    passage = prose(rng, 60)
    held = []
    for _ in range(30):
        p = substring_dedup.Paragraphs([prose(rng, 25) + " " + passage + " " + prose(rng, 25)])
        held.append(dict(zip(p.content(p.a, p.b).tolist(), (p.b - p.a).tolist())))
    shared = set(held[0]).intersection(*held[1:])
    assert sum(held[0][c] for c in shared) >= 34
    assert len(Words(["", "one two", "one  TWO"]).sets()[0]) == 0 and Words(["one two", "one  TWO"]).sets()[0].tolist() == Words(["One\ttwo"]).sets()[0].tolist()


def passages_by_brute_force(texts, least):
    """(doc, first word, last word) of words inside a run of ``least`` words or more that another text has."""
    words = [t.lower().split() for t in texts]
    where = {}
    for d, w in enumerate(words):
        for k in range(len(w) - least + 1):
            where.setdefault(tuple(w[k : k + least]), set()).add(d)
    covered = [set() for _ in texts]
    for d, w in enumerate(words):
        for k in range(len(w) - least + 1):
            if len(where[tuple(w[k : k + least])]) > 1:
                covered[d].update(range(k, k + least))
    return covered


def test_repeated_passages_against_all_runs_of_words(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(60, 300)) for _ in range(80)]
    for _ in range(40):
        passage = prose(rng, rng.randint(10, 140))
        for k in rng.sample(range(80), rng.randint(2, 4)):
            words = texts[k].split(" ")
            at = rng.randrange(len(words))
            texts[k] = " ".join(words[:at]) + rng.choice([" ", "\n"]) + passage + rng.choice([" ", "\n"]) + " ".join(words[at:])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = substring_dedup.repeated_passages(frame, bridge=0).where("not near").collect()
    found = [set() for _ in texts]
    for r in rows:
        before = len(texts[r["doc_id"]][: r["start"]].split())
        inside = len(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]].split())
        found[r["doc_id"]].update(range(before, before + inside))
    sure, possible = passages_by_brute_force(texts, 51), passages_by_brute_force(texts, 26)
    assert all(f <= p for f, p in zip(found, possible))  # nothing shorter is reported
    missed = [d for d in range(80) if sure[d] and not sure[d] & found[d]]
    assert len(missed) <= 0.02 * sum(map(bool, sure))
    assert sum(len(s & f) for s, f in zip(sure, found)) >= 0.88 * sum(map(len, sure))  # but for the ends


def test_lines_against_all_pairs_of_lines(spark):
    rng = random.Random(13)
    base = [prose(rng, rng.randint(32, 90)) for _ in range(25)]
    texts = ["\n".join(changed(rng, rng.choice(base), rng.choice([0.01, 0.02])) if rng.random() < 0.4 else prose(rng, rng.randint(10, 60)) for _ in range(6)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = substring_dedup.repeated_passages(frame).where("near").collect()
    lines = [(d, line) for d, t in enumerate(texts) for line in t.split("\n") if len(line.split()) >= 32]
    group = components(len(lines), alike([runs(x) for _, x in lines]))
    docs_of = {}
    for g, (d, _) in zip(group, lines):
        docs_of.setdefault(g, set()).add(d)
    kinds = {g: {x for h, (_, x) in zip(group, lines) if h == g} for g in docs_of}  # equal lines are left to the anchors
    expected = {(d, texts[d].index(x)): min(docs_of[g]) for g, (d, x) in zip(group, lines) if len(docs_of[g]) > 1 and len(kinds[g]) > 1}
    found = {(r["doc_id"], r["start"]): r["keeper_id"] for r in rows if r["words"] >= 32}
    assert set(found) <= set(expected) and len(expected) - len(found) <= 0.05 * len(expected)
    assert sum(expected[k] == v for k, v in found.items()) >= 0.95 * len(expected)


def test_a_passage_with_a_changed_word_is_cut_whole(spark):
    rng = random.Random(14)
    hit = 0
    for trial in range(3):
        passages = [prose(rng, 60) for _ in range(20)]
        rows = []
        for k, p in enumerate(passages):
            words = p.split(" ")
            rows.append((k, prose(rng, 40) + " " + p + " " + prose(rng, 40)))
            rows.append((k + 100, prose(rng, 40) + " " + " ".join([*words[:30], "changed", *words[31:]]) + " " + prose(rng, 40)))
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        gone = {r["doc_id"]: r["words"] for r in substring_dedup.repeated_passages(frame).where("removed").collect()}
        hit += len(gone)
    assert hit >= 0.8 * 60


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(15)
    passage = prose(rng, 70)
    texts = [prose(rng, 50) + " " + passage + " " + prose(rng, 50) for _ in range(3)]
    once = [(k, t) for k, t in enumerate(texts)]
    rows = lambda some: sorted((r["doc_id"], r["start"], r["length"], r["words"], r["removed"]) for r in substring_dedup.repeated_passages(spark.createDataFrame(some, "doc_id long, text string")).collect())
    assert rows(once) == rows([*once, once[1], once[1]]) and len(rows(once)) == 3
    assert rows([once[0], once[0]]) == []
    two = spark.createDataFrame([(0, texts[0]), (1, texts[1]), (1, prose(rng, 30)), (None, texts[2])], "doc_id long, text string")
    kept = substring_dedup.remove_passages(two).collect()
    assert len(kept) == 4 and sum(passage in r["text"] for r in kept) == 2


def test_a_very_long_text(spark):
    rng = random.Random(16)
    passage = prose(rng, 80)
    long = prose(rng, 250_000)
    frame = spark.createDataFrame([(1, long[:800_000] + " " + passage + " " + long[800_000:]), (2, prose(rng, 30) + " " + passage)], "doc_id long, text string")
    rows = substring_dedup.repeated_passages(frame).collect()
    assert {r["doc_id"] for r in rows} == {1, 2}
    assert simhash.keep_one(frame).count() == 2
    assert simhash.near_duplicates(frame).count() == 2
