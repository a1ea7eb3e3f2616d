"""A declared pipeline over JSON lines: validate, then dedup, then ledger."""

from __future__ import annotations

import hashlib
import json
import sys
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import text as T
from grainmill.operators import dedup, ledger
from grainmill.plans.shared import materialise
from grainmill.sources import jsonl

STAGES = ("validate", "dedup", "ledger")
KNOWN = {
    "validate": {"stage", "kind", "output", "quarantine", "unknown_fields", "max_quarantine_rate"},
    "dedup": {"stage", "fields", "threshold", "ngram", "num_perm", "seed", "near", "strip_punctuation", "reference", "reference_fields", "reference_threshold", "output", "rejects", "clusters"},
    "ledger": {"stage", "fields", "path", "output", "seen"},
}


class SpecError(Exception):
    """The specification can't be used (exit code 78)."""


def load_spec(path: str) -> dict:
    """A TOML or JSON specification: name, input, and a list of stages. Relative paths start at its folder."""
    file = Path(path)
    try:
        spec = tomllib.loads(file.read_text()) if file.suffix == ".toml" else json.loads(file.read_text(), object_pairs_hook=jsonl._no_repeats)
    except (OSError, ValueError) as e:
        raise SpecError(str(e)) from None
    stages = spec.get("stages")
    if set(spec) - {"name", "input", "stages"} or "input" not in spec or not isinstance(stages, list) or not stages:
        raise SpecError("a specification has a name, an input and stages")
    names = [s.get("stage") for s in stages]
    if names[0] != "validate" or any(n not in STAGES for n in names) or len(set(names)) < len(names):
        raise SpecError("stages are validate, dedup and ledger; validate is first, each comes once")
    for s in stages:
        if set(s) - KNOWN[s["stage"]]:
            raise SpecError(f"{s['stage']} doesn't know {sorted(set(s) - KNOWN[s['stage']])[0]!r}")
    place = lambda p: str((file.parent / p).resolve())
    spec["input"] = place(spec["input"])
    outputs = []
    for s in stages:
        for k in ("output", "quarantine", "rejects", "clusters", "seen", "path", "reference"):
            if k in s:
                s[k] = place(s[k])
                outputs += [s[k]] if k not in ("path", "reference") else []
    if len(set(outputs)) < len(outputs) or {spec["input"], *(s.get("reference") for s in stages)} & set(outputs):
        raise SpecError("outputs must differ from each other, the input and the reference")
    return spec


def joined(rows: DataFrame, fields: list[str], strip_punctuation: bool = False) -> DataFrame:
    parts = (T.normalize(F.coalesce(rows[f], F.lit("")), strip_punctuation) for f in fields)
    return rows.select(rows["line"].alias("doc_id"), F.concat_ws("\n", *parts).alias("text"))


def reference_rows(spark: SparkSession, path: str, kind: str, fields: list[str]) -> DataFrame:
    """``(line, *fields)`` of a reference: records of the kind, or plain objects that have one of the fields as text.

    Any other line can't be compared, so that contamination would be missed; it is an error.
    """
    parsed = materialise(jsonl.parse(jsonl.read_lines(spark, path), kind, "metadata"), "reference")
    fine = F.size("reasons") == 0
    plain = F.when(F.try_parse_json(F.col("content").cast("string")).isNotNull(), F.col("content").cast("string"))
    own = {f: F.try_variant_get(F.try_parse_json(plain), f"$.{f}", "string") for f in fields}
    rows = parsed.select("line", *(F.when(fine, parsed[f] if f in parsed.columns else own[f]).otherwise(own[f]).alias(f) for f in fields), fine.alias("_fine"))
    bad = rows.where(~F.col("_fine")).where(" and ".join(f"`{f}` is null" for f in fields)).agg(F.min("line")).first()[0]
    if bad is not None:
        raise SpecError(f"line {bad} of the reference {path} has none of {', '.join(fields)}")
    return rows.drop("_fine")


def digest_of(path: str) -> str:
    """sha256 of a file, read piece by piece."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def run(spark: SparkSession, spec: dict) -> dict:
    """Run all stages and return their counts. What a stage keeps is the next one's input."""
    if Path(spec["input"]).is_dir():
        raise SpecError("the input must be one file, since records are told apart by their lines")
    report: dict = {"pipeline": spec.get("name", "")}
    raw = jsonl.read_lines(spark, spec["input"])
    kind = spec["stages"][0].get("kind", "sft")
    default = ["prompt", "response"] if kind == "sft" else ["prompt", "chosen", "rejected"]
    rows: DataFrame | None = None
    for s in spec["stages"]:
        if s["stage"] == "validate":
            parsed = materialise(jsonl.parse(raw, kind, s.get("unknown_fields", "reject")), "parsed")
            valid, bad = (materialise(x, "routed") for x in jsonl.route(parsed))
            n, m = valid.count(), bad.count()
            codes = bad.select(F.explode(F.array_distinct(F.transform("reasons", lambda r: r["code"]))).alias("code")).groupBy("code").count()
            report["validate"] = {"total": n + m, "valid": n, "quarantined": m, "reasons": {r["code"]: r["count"] for r in codes.orderBy("code").collect()}}
            if "quarantine" in s:
                jsonl.write_lines(bad.select("line", F.to_json(F.struct("line", "id", "reasons", F.col("content").cast("string").alias("record"))).cast("binary").alias("content")), s["quarantine"])
            if m > s.get("max_quarantine_rate", 1.0) * max(n + m, 1):
                if "output" in s:
                    Path(s["output"]).unlink(missing_ok=True)
                report["withheld"] = True
                return report
            rows = valid
        elif s["stage"] == "dedup":
            fields = s.get("fields", default)
            strip, known = s.get("strip_punctuation", False), spark.createDataFrame([], "doc_id long, text string")
            if "reference" in s:
                theirs = s.get("reference_fields", fields)
                known = joined(reference_rows(spark, s["reference"], kind, theirs), theirs, strip)
            decided = dedup.decisions(joined(rows, fields, strip), known, s.get("threshold", 0.8), s.get("reference_threshold", 0.8), s.get("ngram", 3), s.get("num_perm", 128), s.get("seed", 42), s.get("near", True))
            decided = materialise(decided, "decided")
            if "clusters" in s:
                groups = decided.where("reason in ('exact_duplicate', 'near_duplicate')").groupBy(F.col("match").alias("line")).agg(F.sort_array(F.collect_list("id")).alias("members"))
                jsonl.write_lines(groups.select("line", F.to_json(F.struct(F.col("line").alias("kept"), (F.size("members") + 1).alias("size"), "members")).cast("binary").alias("content")), s["clusters"])
            report["dedup"] = {r["reason"]: r["count"] for r in decided.groupBy("reason").count().orderBy("reason").collect()}
            if "rejects" in s:
                gone = decided.where("reason <> 'kept'").select(F.col("id").alias("line"), F.to_json(F.struct(F.col("id").alias("line"), "reason", "match", F.round("similarity", 6).alias("similarity"))).cast("binary").alias("content"))
                jsonl.write_lines(gone, s["rejects"])
            kept = decided.where("reason = 'kept'").select(F.col("id").alias("line"))
            rows = materialise(rows.join(kept, "line", "left_semi"), "kept")
        else:
            fields = s.get("fields", default)
            batch = joined(rows, fields).join(rows.select(rows["line"].alias("doc_id"), F.coalesce("id", "content_id").alias("record_id")), "doc_id")
            batch = batch.select(F.col("doc_id").alias("line"), "record_id", T.content_hash(F.col("text")).alias("digest"))
            config = hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()[:16]
            before = rows

            def hand_over(decided: DataFrame) -> None:
                """The outputs are written before the ledger says that they were delivered."""
                if "seen" in s:
                    jsonl.write_lines(decided.where("action <> 'new'").select("line", F.to_json(F.struct("line", "record_id", "digest", "action", "seen_run", "seen_id")).cast("binary").alias("content")), s["seen"])
                if "output" in s:
                    jsonl.write_lines(before.join(decided.where("action <> 'skipped'").select("line"), "line", "left_semi"), s["output"])

            decided = ledger.Ledger(spark, s["path"]).deliver(batch, spec["input"], digest_of(spec["input"])[:16], spec.get("name", ""), config, hand_over)
            report["ledger"] = {r["action"]: r["count"] for r in decided.groupBy("action").count().orderBy("action").collect()}
            rows = rows.join(decided.where("action <> 'skipped'").select("line"), "line", "left_semi")
            continue
        if "output" in s:
            jsonl.write_lines(rows, s["output"])
    return report


def main(args: list[str]) -> int:
    """``run SPEC``, ``check SPEC``, ``ledger stats|collisions PATH``; 0, 2 (usage), 65 (withheld), 66 (no input), 78 (spec)."""
    if len(args) < 2 or args[0] not in ("run", "check", "ledger"):
        print("usage: run SPEC | check SPEC | ledger stats|collisions PATH", file=sys.stderr)
        return 2
    try:
        if args[0] == "check":
            load_spec(args[1])
            return 0
        spec = load_spec(args[1]) if args[0] == "run" else None
        spark = SparkSession.builder.appName("grainmill").getOrCreate()
        if spec:
            report = run(spark, spec)
            print(json.dumps(report))
            return 65 if report.get("withheld") else 0
        book = ledger.Ledger(spark, args[2], create=False)
        tables = [ledger.stats(book.records(), book.runs())] if args[1] == "stats" else [ledger.id_collisions(book.records()), ledger.content_collisions(book.records())]
        for t in tables:
            for row in t.toJSON().toLocalIterator():
                print(row)
        return 0
    except SpecError as e:
        print(e, file=sys.stderr)
        return 78
    except (FileNotFoundError, ledger.LedgerError) as e:
        print(e, file=sys.stderr)
        return 66
