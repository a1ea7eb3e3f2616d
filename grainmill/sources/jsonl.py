"""Records from JSON lines: numbered bytes, strict parsing, rules with stable codes, and the way back."""

from __future__ import annotations

import hashlib
import json
import math
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
PARSED = "line long, content binary, kind string, id string, content_id string, prompt string, response string, chosen string, rejected string, reasons array<struct<code:string,field:string,message:string>>, unknown array<string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, content)`` with line numbers from 1 and bytes as they are, without line ends and a leading mark.

    A file is a row before it is cut, so it should not exceed some hundred megabytes; many files are read in parallel.
    """
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = data.removeprefix(b"\xef\xbb\xbf").split(b"\n")
                if lines and not lines[-1]:
                    lines.pop()
                for k in range(0, len(lines), 10_000):
                    some = [x.rstrip(b"\r") for x in lines[k : k + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(range(k + 1, k + 1 + len(some)), pa.int64()), pa.array(some, pa.binary())], ["file", "line", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cut, "file string, line long, content binary")


class Rejected(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        names = [k for k, _ in pairs]
        raise Rejected("duplicate_key", f"key {next(k for k in names if names.count(k) > 1)!r} is given twice")
    return out


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise Rejected("non_finite_number", f"{text} is not a finite number")
    return value


def decode(raw: bytes) -> object:
    """Strict JSON: UTF-8, no repeated keys, finite numbers only."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Rejected("invalid_encoding", str(e)) from None
    try:
        return json.loads(text, object_pairs_hook=_no_repeats, parse_float=_finite, parse_constant=_finite)
    except Rejected:
        raise
    except (ValueError, RecursionError) as e:
        raise Rejected("invalid_json", str(e)) from None


Issue = tuple[str, str, str]


def _text(value: object, field: str, issues: list[Issue]) -> None:
    if not isinstance(value, str):
        issues.append(("string_type", field, "must be a string"))
    elif not value.strip():
        issues.append(("blank_text", field, "must not be blank"))


def _messages(value: object, field: str, least: int, issues: list[Issue]) -> None:
    if not isinstance(value, list):
        issues.append(("list_type", field, "must be a list"))
        return
    if len(value) < least:
        issues.append(("too_short", field, f"must have {least} messages or more"))
    for k, m in enumerate(value):
        at = f"{field}[{k}]"
        if not isinstance(m, dict):
            issues.append(("dict_type", at, "must be an object"))
            continue
        issues += [("extra_forbidden", f"{at}.{x}", "is not known") for x in m if x not in ("role", "content", "name")]
        issues += [("missing", f"{at}.{x}", "is required") for x in ("role", "content") if x not in m]
        if "role" in m and m["role"] not in ROLES:
            issues.append(("literal_error", f"{at}.role", f"must be one of {', '.join(ROLES)}"))
        if "content" in m:
            _text(m["content"], f"{at}.content", issues)
        if m.get("name") is not None and (not isinstance(m["name"], str) or not m["name"]):
            issues.append(("string_type" if not isinstance(m["name"], str) else "too_short", f"{at}.name", "must be a name"))


def order_code(roles: list[str], first: str, last: str, system: bool = True) -> str | None:
    """The first broken rule of turn order; see ``operators.validate.turn_order``."""
    if "system" in roles[1 if system else 0 :]:
        return "misplaced_system_message"
    turns = roles[1:] if roles[:1] == ["system"] else roles
    if not turns:
        return "no_turns"
    if turns[0] != first:
        return f"first_turn_not_{first}"
    for a, b in zip(turns, turns[1:]):
        if b == "tool" and a not in ("assistant", "tool"):
            return "orphan_tool_message"
        if a == b and a in ("user", "assistant"):
            return "consecutive_same_role"
    return None if roles[-1] == last else f"last_turn_not_{last}"


def _id(value: object, issues: list[Issue]) -> str | None:
    if value is None:
        return None
    if isinstance(value, int) and not isinstance(value, bool):
        value = str(value)
    if not isinstance(value, str):
        issues.append(("string_type", "id", "must be a string or a whole number"))
        return None
    if not 1 <= len(value) <= 256 or any(c.isspace() for c in value):
        issues.append(("invalid_id", "id", "must be 1 to 256 characters without white space"))
        return None
    return value


def check(record: dict, kind: str, unknown_fields: str = "reject") -> tuple[dict, list[Issue], list[str]]:
    """The record's id, shape, texts and content id; what is wrong with it; and its unknown fields."""
    issues: list[Issue] = []
    fields = {"sft": ("messages", "system", "prompt", "response"), "preference": ("prompt", "chosen", "rejected", "score_chosen", "score_rejected")}[kind]
    if kind == "sft":
        chat = "messages" in record
        shape = ("messages",) if chat else ("system", "prompt", "response")
        known = chat or "prompt" in record or "response" in record
    else:
        chat = any(isinstance(record.get(x), list) for x in ("prompt", "chosen", "rejected"))
        shape, known = fields, any(x in record for x in ("prompt", "chosen", "rejected"))
    if not known:
        return {}, [("unknown_record_shape", "", "has none of the fields of its kind")], []
    unknown = [x for x in record if x not in (*shape, "id", "metadata")]
    if unknown_fields == "reject" or not isinstance(record.get("metadata", {}), dict):
        issues += [("extra_forbidden", x, "is not known") for x in unknown]
    out: dict = {"kind": f"{kind}_{'chat' if chat else 'text'}", "id": _id(record.get("id"), issues)}
    if record.get("metadata") is not None and not isinstance(record["metadata"], dict):
        issues.append(("dict_type", "metadata", "must be an object"))
    required = ("messages",) if kind == "sft" and chat else ("prompt", "response") if kind == "sft" else ("prompt", "chosen", "rejected")
    issues += [("missing", x, "is required") for x in required if x not in record]
    for x in (*required, *(("system",) if record.get("system") is not None and not chat else ())):
        if x in record:
            _messages(record[x], x, 2 if x == "messages" else 1, issues) if chat else _text(record[x], x, issues)
    for x in ("score_chosen", "score_rejected") if kind == "preference" else ():
        if record.get(x) is not None and (isinstance(record[x], bool) or not isinstance(record[x], (int, float))):
            issues.append(("float_type", x, "must be a number"))
    if issues:
        return out, issues, unknown
    lists = {x: record[x] if chat else [{"role": "user" if x == "prompt" else "assistant", "content": record[x]}] for x in required}
    if kind == "sft":
        messages = lists["messages"] if chat else [*([{"role": "system", "content": record["system"]}] if record.get("system") else []), *lists["prompt"], *lists["response"]]
        code = order_code([m["role"] for m in messages], "user", "assistant")
        content: object = messages
        out |= {"prompt": "\n".join(m["content"] for m in messages[:-1]), "response": messages[-1]["content"]}
    else:
        squeezed = {x: [(m["role"], " ".join(m["content"].split())) for m in v] for x, v in lists.items()}
        low, high = record.get("score_chosen"), record.get("score_rejected")
        code = order_code([m["role"] for m in lists["prompt"]], "user", "user") or next((c for x in ("chosen", "rejected") if (c := order_code([m["role"] for m in lists[x]], "assistant", "assistant", False))), None)
        code = code or ("identical_responses" if squeezed["chosen"] == squeezed["rejected"] else "chosen_scored_below_rejected" if low is not None and high is not None and low < high else None)
        content = lists
        out |= {x: "\n".join(m["content"] for m in v) for x, v in lists.items()}
    if code:
        issues.append((code, "", "breaks a rule of its kind"))
    plain = json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    try:
        out["content_id"] = hashlib.sha256(plain.encode()).hexdigest()[:16]
    except UnicodeEncodeError:
        issues.append(("invalid_unicode", "", "has half of a surrogate pair"))
        out = {k: v for k, v in out.items() if k in ("kind", "id")}
    return out, issues, unknown


def parse(lines: DataFrame, kind: str, unknown_fields: str = "reject") -> DataFrame:
    """A row per line that is not blank: its texts, ids and all reasons against it (none: it may pass)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reason = pa.list_(pa.struct([("code", pa.string()), ("field", pa.string()), ("message", pa.string())]))
        names = ["kind", "id", "content_id", "prompt", "response", "chosen", "rejected"]
        for batch in batches:
            rows, wrong, odd = [], [], []
            for raw in batch.column(1).to_pylist():
                out, issues, unknown = {}, [], []
                try:
                    value = decode(raw)
                    out, issues, unknown = check(value, kind, unknown_fields) if isinstance(value, dict) else ({}, [("not_an_object", "", "must be an object")], [])
                except Rejected as e:
                    issues = [(e.code, "", str(e))]
                rows.append(out)
                wrong.append([dict(zip(("code", "field", "message"), (x.encode("utf-8", "replace").decode() for x in i))) for i in issues])
                odd.append(unknown)
            columns = [pa.array([r.get(n) for r in rows], pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(wrong, reason), pa.array(odd, pa.list_(pa.string()))], ["line", "content", *names, "reasons", "unknown"])

    filled = lines.select("line", "content").where(F.length(F.trim(F.translate(F.col("content").cast("string"), "\t\r\n\v\f", ""))) > 0)
    return filled.mapInArrow(run, PARSED)


def route(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined ones; of rows that pass, the first of each id (or content, without an id) is valid."""
    key = F.coalesce("id", "content_id")
    fine = parsed.where(F.size("reasons") == 0).withColumn("key", key)
    first = fine.groupBy("key").agg(F.min("line").alias("first"), F.min_by("content_id", "line").alias("first_content"))
    fine = fine.join(first, "key")
    message = F.when(F.col("content_id") == F.col("first_content"), F.concat(F.lit("matches the content of line "), "first")).otherwise(F.concat(F.lit("was already used by line "), "first"))
    again = fine.where("line > first").withColumn("reasons", F.array(F.struct(F.lit("duplicate_id").alias("code"), F.lit("id").alias("field"), message.alias("message"))))
    names = parsed.columns
    return fine.where("line = first").select(*names), parsed.where(F.size("reasons") > 0).unionByName(again.select(*names))


def write_lines(rows: DataFrame, path: str) -> None:
    """Write ``rows(line, content)`` to one file, in order, at once or not at all. For results that one machine holds."""
    target = Path(path)
    aside = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        with aside.open("wb") as f:
            for r in rows.select("line", "content").orderBy("line").toLocalIterator():
                f.write(bytes(r["content"]) + b"\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(aside, target)
    finally:
        aside.unlink(missing_ok=True)
