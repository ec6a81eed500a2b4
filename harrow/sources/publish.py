"""Tables in versions: staged, held against gates and what is there, and made visible by one rename; and back-fills that resume."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """A figure of a table and a rule, both in SQL; the rule is over ``new`` and ``old`` (null without a version before); a null rule isn't met."""

    name: str
    measure: str
    rule: str


class RefusedError(ValueError):
    """The staged version doesn't meet its gates; the rows of the report are in ``report``."""

    def __init__(self, report: list[dict[str, Any]]):
        super().__init__("refused: " + ", ".join(f"{r['gate']} (old {r['old']}, new {r['new']})" for r in report if not r["passed"]))
        self.report = report


class Versions:
    """Versions of a table below a folder that driver and executors share.

    A version is a folder of its own, and a manifest with the highest number names the one to read. A manifest appears by one
    rename of a whole file; so a reader sees a version wholly or not at all, and a job that dies midway leaves what was
    there. Folders that no manifest names are remains of such jobs; :meth:`sweep` removes them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str = ""):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        path, fs = self._path()
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in found if n.startswith(prefix))

    def manifests(self) -> list[dict[str, Any]]:
        """All manifests, oldest first."""
        return [self._read(n) for n in self._names("manifest-")]

    def _read(self, name: str) -> dict[str, Any]:
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def latest(self) -> dict[str, Any] | None:
        names = self._names("manifest-")
        return self._read(names[-1]) if names else None

    def commit(self, manifest: dict[str, Any], after: dict[str, Any] | None) -> dict[str, Any]:
        """Make a manifest the latest one, unless another has been made since ``after``."""
        manifest = manifest | {"number": (after["number"] if after else 0) + 1}
        source, fs = self._path(f"_{uuid.uuid4().hex}")
        target, _ = self._path(f"manifest-{manifest['number']:09d}")
        stream = fs.create(source)
        try:
            stream.write(bytearray(json.dumps(manifest, default=str).encode()))
        finally:
            stream.close()
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, False)
            raise RuntimeError("another version has been published meanwhile")
        return manifest

    def current(self) -> DataFrame | None:
        """The table to read, or None before the first version."""
        manifest = self.latest()
        return self.spark.read.parquet(f"{self.root}/{manifest['version']}") if manifest else None

    def report(self, new: DataFrame, gates: list[Gate], old: DataFrame | None = None) -> DataFrame:
        """gate, old, new and passed for each gate; two aggregations of one row, whatever the number of gates."""
        old = self.current() if old is None else old
        measures = [F.expr(g.measure).cast("double").alias(f"g{i}") for i, g in enumerate(gates)]
        after = new.agg(F.struct(*measures).alias("after"))
        before = old.agg(F.struct(*measures).alias("before")) if old is not None else after.select(F.lit(None).cast(after.schema["after"].dataType).alias("before"))
        rows = F.array(*(F.struct(F.lit(g.name).alias("gate"), F.lit(g.rule).alias("rule"), F.col(f"before.g{i}").alias("old"), F.col(f"after.g{i}").alias("new")) for i, g in enumerate(gates)))
        each = after.crossJoin(before).select(F.inline(rows))  # one row each
        passed = F.lit(False)
        for rule in dict.fromkeys(g.rule for g in gates):
            passed = F.when(F.col("rule") == rule, F.coalesce(F.expr(rule), F.lit(False))).otherwise(passed)
        return each.select("gate", "old", "new", passed.alias("passed"))

    def publish(self, table: DataFrame, gates: list[Gate]) -> list[dict[str, Any]]:
        """Stage a table, hold it against the gates and make it current; the report. Refused tables leave no trace."""
        after = self.latest()
        version = f"v-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.root}/{version}")
        staged = self.spark.read.schema(table.schema).parquet(f"{self.root}/{version}")
        report = [r.asDict() for r in self.report(staged, gates).collect()] if gates else []
        if not all(r["passed"] for r in report):
            path, fs = self._path(version)
            fs.delete(path, True)
            raise RefusedError(report)
        self.commit({"version": version, "report": report}, after)
        return report

    def roll_back(self) -> None:
        """Make the version before the current one current again, by a manifest of its own."""
        manifests = self.manifests()
        earlier = [m for m in manifests if m["version"] != manifests[-1]["version"]] if manifests else []
        if not earlier:
            raise ValueError("there is no version before this one")
        self.commit(earlier[-1] | {"rolled_back_from": manifests[-1]["version"]}, manifests[-1])

    def sweep(self) -> list[str]:
        """Remove folders and files that no manifest names; only while nothing is being published."""
        named = {m["version"] for m in self.manifests()}
        gone = [n for n in self._names("v-") + self._names("_") if n not in named]
        for name in gone:
            path, fs = self._path(name)
            fs.delete(path, True)
        return gone


def backfill(spark: SparkSession, source: str, root: str, lacking: Column, fill: Callable[[DataFrame], DataFrame], files: int = 64, most: int | None = None) -> DataFrame | None:
    """A copy of a Parquet table in which rows that lack something are filled, made in batches of source files; resumes where it stopped.

    ``fill`` gets the rows for which ``lacking`` holds and returns them with the same columns; others, also where it is null, stay as they are. Each
    batch is written whole, then entered with its files in a manifest; so a run after a stop reads no finished file
    again, and a batch that was under way is written anew in its own folder. With ``most`` only so many batches are made. Returns what
    is finished so far, or None if nothing is.
    """
    versions = Versions(spark, root)
    state = versions.latest() or {"number": 0, "batches": {}}
    done = {f for batch in state["batches"].values() for f in batch}
    left = sorted(f for f in spark.read.parquet(source).inputFiles() if f not in done)
    for at in range(0, min(len(left), files * most) if most is not None else len(left), files):
        part = left[at : at + files]
        name = "b-" + hashlib.md5("\n".join(part).encode(), usedforsecurity=False).hexdigest()
        rows = spark.read.parquet(*part)
        missing = F.coalesce(lacking, F.lit(False))
        rows.where(~missing).unionByName(fill(rows.where(missing)).select(*rows.columns)).write.mode("overwrite").parquet(f"{root}/{name}")
        state = versions.commit({"batches": state["batches"] | {name: part}}, state if state["number"] else None)
    return spark.read.parquet(*(f"{root}/{n}" for n in state["batches"])) if state["batches"] else None


def sent_in_batches(table: DataFrame, keys: list[str], send: Callable[[str, pd.DataFrame], None], size: int = 100) -> DataFrame:
    """batch_id and n of each batch that ``send`` took, at most ``size`` rows each; the table is read once, when the result is.

    Rows are dealt and sorted by key, so a task that runs again, after a lost executor, cuts the same batches. An id is a hash of
    the batch's rows: a receiver that passes over ids it knows takes each batch once, however often it is sent. An empty table sends nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0

        def out(rows: pd.DataFrame) -> tuple[str, int]:
            batch_id = hashlib.md5(rows.to_json(orient="values", date_format="iso", default_handler=str).encode(), usedforsecurity=False).hexdigest()
            send(batch_id, rows)
            return batch_id, len(rows)

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= size:
                rows = pd.concat(held, ignore_index=True)
                whole = n - n % size
                yield pd.DataFrame([out(rows.iloc[at : at + size].reset_index(drop=True)) for at in range(0, whole, size)], columns=["batch_id", "n"])
                held, n = [rows.iloc[whole:]], n - whole
        if n:
            yield pd.DataFrame([out(pd.concat(held, ignore_index=True))], columns=["batch_id", "n"])

    others = [c for c in table.columns if c not in keys]
    dealt = table.repartition(*keys).sortWithinPartitions(*keys, *others)
    return dealt.mapInPandas(run, "batch_id string, n long")
