"""The pipeline's stages, one after the other, on planted cases and against brute force."""

import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from grainmill.llm import simhash
from grainmill.llm.common import tokenizer_path


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8))) for _ in range(n))


def groups(texts: dict[int, str]) -> dict[int, int]:
    """The smallest id that links by Jaccard similarity reach, over all pairs."""
    sets = {k: set(simhash.shingle_hashes(t, 5).tolist()) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            same = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            if same:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: find(k) for k in texts}


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    texts = {k: prose(rng, 90) for k in range(300)}
    toxic = {k for k in texts if k % 10 == 3}
    for k in toxic:
        words = texts[k].split(" ")
        words[rng.randrange(90)] = "moronic"
        texts[k] = " ".join(words)
    for k in (50, 51, 52):
        words = texts[40].split(" ")
        words[k % 7] = "changed"
        texts[k] = " ".join(words)
    texts[61] = texts[60]
    passage = prose(rng, 70)
    for k in (70, 81, 92):
        words = texts[k].split(" ")
        texts[k] = " ".join([*words[:30], passage, *words[30:]])
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, found = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 3:
            assert docs.columns == columns
            found.append({r["doc_id"]: r for r in docs.collect()})
    clean, single, cut = found
    assert set(clean) == set(texts) - toxic
    of = groups({k: r["text"] for k, r in clean.items()})
    assert set(single) == {k for k in clean if of[k] == k} and {50, 51, 52, 61}.isdisjoint(single)
    assert [k for k in (70, 81, 92) if passage in cut[k]["text"]] == [70]
    assert all(cut[k]["text"] == single[k]["text"] for k in single if k not in (81, 92)) and all(r["n_chars"] == len(r["text"]) for r in cut.values())
    library, ids = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), {}
    for p in sorted(docs.collect(), key=lambda p: p["start"]):
        ids.setdefault(p["doc_id"], []).extend(np.frombuffer(p["ids"], "<u4").tolist())
    assert ids == {k: [*library.encode(r["text"], add_special_tokens=False).ids, 0] for k, r in cut.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
