"""Runs: a manifest beside the tables, stages with prerequisites, frozen inputs, and validation by replay."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators.checks import difference
from spanloom.operators.hashtree import located
from spanloom.sources.jsonio import _exists, publish_text, read_manifest

RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


@dataclass
class Run:
    """A run folder. A completed run never changes; a resumed one must have the same contract."""

    spark: SparkSession
    root: str
    contract: dict
    stages: dict[str, str] = field(default_factory=dict)
    status: str = "running"
    lock: Lock = field(default_factory=Lock, repr=False, compare=False)

    @classmethod
    def start(cls, spark: SparkSession, base: str, run_id: str, contract: dict, resume: bool = False) -> Run:
        if not RUN_ID.fullmatch(run_id):
            raise ValueError(f"not a run id: {run_id!r}")
        run = cls(spark, f"{base}/{run_id}", contract)
        if _exists(spark, f"{run.root}/manifest.json"):
            known = read_manifest(spark, f"{run.root}/manifest.json")
            if not resume or known["status"] == "completed":
                raise ValueError(f"run {run_id} exists and is {known['status']}")
            if known["contract"] != contract:
                raise ValueError("a resumed run needs the same contract")
            run.stages = known["stages"]
        run._save()
        return run

    def _save(self) -> None:
        """Written aside and renamed over the old one, by one thread at a time: a crash leaves a whole manifest."""
        with self.lock:
            body = json.dumps({"contract": self.contract, "stages": self.stages, "status": self.status}, sort_keys=True)
            publish_text(self.spark, f"{self.root}/manifest.json", body)

    def stage(self, name: str, make: Callable[[], DataFrame], after: tuple[str, ...] = ()) -> DataFrame:
        """The stage's table: read if the manifest has it, else made and written. Prerequisites must be there."""
        for other in after:
            if other not in self.stages:
                raise ValueError(f"{name} needs {other}")
        if name not in self.stages:
            path = f"{self.root}/{name}"
            make().write.mode("overwrite").parquet(path)
            self.stages[name] = path
            self._save()
        return self.spark.read.parquet(self.stages[name])

    def together(self, makes: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
        """Independent stages as jobs side by side; one that fails doesn't stop the others."""
        with ThreadPoolExecutor(max_workers=len(makes)) as pool:
            jobs = {name: pool.submit(self.stage, name, make) for name, make in makes.items()}
        return {name: job.result() for name, job in jobs.items()}

    def finish(self, required: tuple[str, ...]) -> None:
        missing = [s for s in required if s not in self.stages]
        self.status = "failed" if missing else "completed"
        self._save()
        if missing:
            raise ValueError(f"missing stages: {missing}")

    def replay(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The rows in which a stage, made again, differs from what was written."""
        return difference(make(), self.spark.read.parquet(self.stages[name]))

    def located(self, name: str, make: Callable[[], DataFrame], keys: tuple[str, ...]) -> DataFrame:
        """As replay(), by trees of hashes: which cells of a stage differ from what it gives when made again."""
        return located(self.spark.read.parquet(self.stages[name]), make(), keys)
