"""Content that was delivered before, across runs: a table of runs and a table of records, versioned together."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "digest string, record_id string, run_id string, line long, batch long"
RUNS = "run_id string, pipeline string, config_digest string, source string, source_digest string, started_at string, batch long, total long, kept long, skipped long, rerun long"


def split_batch(batch: DataFrame, records: DataFrame, runs: DataFrame, source_digest: str) -> DataFrame:
    """``(line, record_id, digest, action, seen_run, seen_id)`` of every row of ``batch(line, record_id, digest)``.

    new: the digest is in no record. rerun: its earliest record is of a run over the same source bytes; kept again.
    skipped: it was delivered from another source. Rows of one batch don't hide each other.
    """
    order = F.struct("batch", "line", "record_id")
    first = records.groupBy("digest").agg(F.min_by(F.struct("run_id", "record_id"), order).alias("first"))
    sightings = first.select("digest", F.col("first.run_id").alias("seen_run"), F.col("first.record_id").alias("seen_id"))
    own = runs.select(F.col("run_id").alias("seen_run"), F.col("source_digest").alias("seen_source_digest"))
    known = batch.join(sightings, "digest", "left").join(own, "seen_run", "left")
    action = F.when(F.col("seen_run").isNull(), "new").when(F.col("seen_source_digest") == source_digest, "rerun").otherwise("skipped")
    return known.select("line", "record_id", "digest", action.alias("action"), "seen_run", "seen_id")


def added_records(decided: DataFrame, records: DataFrame) -> DataFrame:
    """The (digest, record_id) pairs to append: delivered ones that the ledger lacks, each once by its first line."""
    fresh = decided.where("action <> 'skipped'").groupBy("digest", "record_id").agg(F.min("line").alias("line"))
    return fresh.join(records.select("digest", "record_id"), ["digest", "record_id"], "left_anti")


def stats(records: DataFrame, runs: DataFrame) -> DataFrame:
    counts = records.agg(F.count("*").alias("records"), F.countDistinct("digest").alias("contents"), F.countDistinct("record_id").alias("ids"))
    return counts.crossJoin(F.broadcast(runs.agg(F.count("*").alias("runs"))))  # one row each


def id_collisions(records: DataFrame) -> DataFrame:
    """Ids with more than one content."""
    return records.groupBy("record_id").agg(F.countDistinct("digest").alias("contents")).where("contents > 1")


def content_collisions(records: DataFrame) -> DataFrame:
    """Contents under more than one id."""
    return records.groupBy("digest").agg(F.count("*").alias("ids"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id")).where("ids > 1")


class LedgerError(Exception):
    """The ledger is missing, locked or broken."""


class Ledger:
    """A folder with ``records/`` and ``runs/``, both appended as Parquet, and CURRENT, which names what counts.

    A commit writes new files first and then replaces CURRENT at once, so a failed run leaves the ledger as it was.
    One writer at a time: a lock file is waited for up to ``patience`` seconds.
    """

    def __init__(self, spark: SparkSession, folder: str, create: bool = True, patience: float = 5.0):
        self.spark, self.folder, self.patience = spark, Path(folder), patience
        if not (self.folder / "CURRENT").exists():
            if not create:
                raise LedgerError(f"there is no ledger at {folder}")
            self.folder.mkdir(parents=True, exist_ok=True)
            self._point({"records": [], "runs": [], "batch": 0})

    def _point(self, current: dict) -> None:
        aside = self.folder / f"CURRENT.{uuid.uuid4().hex}"
        aside.write_text(json.dumps(current))
        os.replace(aside, self.folder / "CURRENT")

    def _current(self) -> dict:
        return json.loads((self.folder / "CURRENT").read_text())

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [str(self.folder / p) for p in self._current()[kind]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def records(self) -> DataFrame:
        return self._read("records", RECORDS)

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    @contextmanager
    def _locked(self):
        lock, until = self.folder / "LOCK", time.monotonic() + self.patience
        while True:
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                if time.monotonic() > until:
                    raise LedgerError(f"another run holds {lock}") from None
                time.sleep(0.05)
        try:
            yield
        finally:
            lock.unlink(missing_ok=True)

    def deliver(self, batch: DataFrame, source: str, source_digest: str, pipeline: str = "", config_digest: str = "", hand_over: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Decide ``batch(line, record_id, digest)`` and record what is delivered; returns the decisions.

        ``hand_over`` gets the decisions before they count. If it fails, so does the run, and the ledger stays as it was.
        """
        with self._locked():
            current, run = self._current(), uuid.uuid4().hex[:16]
            number = current["batch"] + 1
            place = f"work/{run}/decided"
            split_batch(batch, self.records(), self.runs(), source_digest).write.parquet(str(self.folder / place))
            decided = self.spark.read.parquet(str(self.folder / place))
            counts = {r["action"]: r["n"] for r in decided.groupBy("action").agg(F.count("*").alias("n")).collect()}
            fresh = added_records(decided, self.records()).select("digest", "record_id", F.lit(run).alias("run_id"), "line", F.lit(number).cast("long").alias("batch"))
            fresh.write.parquet(str(self.folder / f"records/{run}"))
            total, skipped, rerun = sum(counts.values()), counts.get("skipped", 0), counts.get("rerun", 0)
            row = (run, pipeline, config_digest, source, source_digest, datetime.now(UTC).isoformat(), number, total, total - skipped, skipped, rerun)
            self.spark.createDataFrame([row], RUNS).write.parquet(str(self.folder / f"runs/{run}"))
            if hand_over:
                hand_over(decided)
            self._point({"records": [*current["records"], f"records/{run}"], "runs": [*current["runs"], f"runs/{run}"], "batch": number})
            return decided
