"""JSON lines through the declared pipeline."""

import json

import pytest

from grainmill.operators import ledger
from grainmill.plans import pipeline
from grainmill.sources import jsonl, tables

LONG = " ".join(f"token{k}" for k in range(80))


def sft(prompt, response, **more):
    return json.dumps({"prompt": prompt, "response": response, **more}).encode()


@pytest.mark.parametrize(
    ("raw", "code"),
    [(b"\xff{}", "invalid_encoding"), (b"{", "invalid_json"), (b'{"a":1,"a":2}', "duplicate_key"), (b'{"a":NaN}', "non_finite_number"), (b'{"a":1e999}', "non_finite_number")],
)
def test_strict_json(raw, code):
    with pytest.raises(jsonl.Rejected) as e:
        jsonl.decode(raw)
    assert e.value.code == code


@pytest.mark.parametrize(
    ("record", "kind", "codes"),
    [
        ({"prompt": "a", "response": "b", "id": 7}, "sft", set()),
        ({"prompt": " ", "response": 3}, "sft", {"blank_text", "string_type"}),
        ({"prompt": "a"}, "sft", {"missing"}),
        ({"x": 1}, "sft", {"unknown_record_shape"}),
        ({"prompt": "a", "response": "b", "x": 1, "id": "a b"}, "sft", {"extra_forbidden", "invalid_id"}),
        ({"messages": [{"role": "user", "content": "a"}]}, "sft", {"too_short"}),
        ({"messages": [{"role": "bot", "content": "a"}, 4]}, "sft", {"literal_error", "dict_type"}),
        ({"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": "b"}]}, "sft", {"consecutive_same_role"}),
        ({"prompt": "a", "response": "\ud800"}, "sft", {"invalid_unicode"}),
        ({"prompt": "a", "chosen": "b c", "rejected": " b  c"}, "preference", {"identical_responses"}),
        ({"prompt": "a", "chosen": "b", "rejected": "c", "score_chosen": 1, "score_rejected": 2}, "preference", {"chosen_scored_below_rejected"}),
        ({"prompt": "a", "chosen": "b", "rejected": "c", "score_chosen": True}, "preference", {"float_type"}),
    ],
)
def test_codes(record, kind, codes):
    assert {c for c, *_ in jsonl.check(record, kind)[1]} == codes


def test_chat_and_flat_share_content_id():
    flat = jsonl.check({"prompt": "a", "response": "b"}, "sft")[0]
    chat = jsonl.check({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "sft")[0]
    assert flat["content_id"] == chat["content_id"]


def test_pipeline(spark, tmp_path):
    near = LONG.replace("token40", "other")
    lines = [b"\xef\xbb\xbf" + sft("q", LONG, id="a"), sft("q", near, id="b"), sft("Q ", LONG, id="c"), b"", sft("other", "text of its own kind", id="d"), sft("x", "y", id="d"), b"broken"]
    (tmp_path / "in.jsonl").write_bytes(b"\r\n".join(lines) + b"\n")
    spec = {"name": "t", "input": "in.jsonl", "stages": [{"stage": "validate", "output": "ok.jsonl", "quarantine": "bad.jsonl"}, {"stage": "dedup", "output": "kept.jsonl", "rejects": "gone.jsonl"}, {"stage": "ledger", "path": "ledger", "output": "new.jsonl"}]}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    report = pipeline.run(spark, pipeline.load_spec(str(tmp_path / "spec.json")))
    assert report["validate"] == {"total": 6, "valid": 4, "quarantined": 2, "reasons": {"duplicate_id": 1, "invalid_json": 1}}
    assert report["dedup"] == {"exact_duplicate": 1, "kept": 2, "near_duplicate": 1} and report["ledger"] == {"new": 2}
    assert (tmp_path / "new.jsonl").read_bytes() == sft("q", LONG, id="a") + b"\n" + lines[4] + b"\n"
    assert pipeline.run(spark, pipeline.load_spec(str(tmp_path / "spec.json")))["ledger"] == {"rerun": 2}


def test_specs_that_fail(tmp_path):
    for stages in ([], [{"stage": "dedup"}], [{"stage": "validate", "x": 1}], [{"stage": "validate", "output": "i"}]):
        (tmp_path / "s.json").write_text(json.dumps({"input": "i", "stages": stages}))
        assert pipeline.main(["check", str(tmp_path / "s.json")]) == 78
    assert pipeline.main([]) == 2


def test_index_is_dense(spark):
    rows = spark.range(100).repartition(7)
    assert sorted(r["__INDEX__"] for r in tables.with_index(rows).collect()) == list(range(100))
    assert all(r["id"] == r["__INDEX__"] for r in tables.with_index(rows, "id").collect())


def write_spec(folder, lines, reference, **options):
    (folder / "in.jsonl").write_bytes(b"\n".join(lines) + b"\n")
    (folder / "ref.jsonl").write_bytes(b"\n".join(reference) + b"\n")
    stages = [{"stage": "validate"}, {"stage": "dedup", "reference": "ref.jsonl", **options}, {"stage": "ledger", "path": "ledger", "output": "new.jsonl"}]
    (folder / "spec.json").write_text(json.dumps({"name": "r", "input": "in.jsonl", "stages": stages}))
    return pipeline.load_spec(str(folder / "spec.json"))


def test_references_of_plain_objects(spark, tmp_path):
    lines = [sft(LONG, "own answer", id="a"), sft("what else", "other words here", id="b")]
    plain = json.dumps({"prompt": LONG, "source": "exam"}).encode()
    report = pipeline.run(spark, write_spec(tmp_path, lines, [plain, sft("no", "match")], fields=["prompt"]))
    assert report["dedup"] == {"contaminated": 1, "kept": 1}
    for broken in (b"broken", b"[1]", b'{"text": "of another name"}'):
        with pytest.raises(pipeline.SpecError, match="line 2"):
            pipeline.run(spark, write_spec(tmp_path, lines, [plain, broken], fields=["prompt"]))


def test_clusters_file_and_no_near(spark, tmp_path):
    near = LONG.replace("token40", "other")
    lines = [sft("q", LONG, id="a"), sft("Q", LONG, id="b"), sft("q", near, id="c"), sft("q", LONG + "!", id="d")]
    none = [sft("unlike", "all of them")]
    pipeline.run(spark, write_spec(tmp_path, lines, none, clusters="groups.jsonl"))
    assert [json.loads(x) for x in (tmp_path / "groups.jsonl").read_text().splitlines()] == [{"kept": 1, "size": 4, "members": [2, 3, 4]}]
    exact = pipeline.run(spark, write_spec(tmp_path, lines, none, near=False, strip_punctuation=True))
    assert exact["dedup"] == {"exact_duplicate": 2, "kept": 2}


def test_a_ledger_counts_only_what_was_written(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    batch = spark.createDataFrame([(1, "a", "d1")], "line long, record_id string, digest string")

    def fails(decided):
        raise OSError("disk full")

    with pytest.raises(OSError):
        book.deliver(batch, "s", "bytes", hand_over=fails)
    assert book.records().count() == 0
    assert [r["action"] for r in book.deliver(batch, "other", "more bytes").collect()] == ["new"]


def test_ids_that_are_no_text():
    for value in (True, 1.5, ["a"]):
        assert {c for c, *_ in jsonl.check({"prompt": "a", "response": "b", "id": value}, "sft")[1]} == {"string_type"}
    assert jsonl.check({"prompt": "a", "response": "b", "id": 7}, "sft")[1] == []
