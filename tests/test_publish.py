"""Versions of a table behind gates, back-fills that resume, and batches that may be sent again."""

from __future__ import annotations

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from harrow.sources.publish import Gate, RefusedError, Versions, backfill, sent_in_batches

GATES = [Gate("rows", "count(*)", "old IS NULL OR new >= old"), Gate("nulls", "count_if(v IS NULL)", "new = 0")]


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def rows_of(df) -> list[tuple]:  # noqa: ANN001
    return sorted(tuple(r) for r in df.collect())


def test_only_whole_versions_that_meet_their_gates_are_seen(spark, folder):
    ddl = "k long, v string"
    v = Versions(spark, f"{folder}/t")
    assert v.current() is None and v.latest() is None
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], ddl), spark.createDataFrame([(1, "c"), (2, "d"), (3, "e")], ddl)
    report = v.publish(one, GATES)
    assert [(r["gate"], r["old"], r["new"], r["passed"]) for r in report] == [("rows", None, 2.0, True), ("nulls", None, 0.0, True)]
    with pytest.raises(RefusedError, match="rows .old 2.0, new 1.0"):
        v.publish(one.limit(1), GATES)
    with pytest.raises(RefusedError, match="nulls"):
        v.publish(two.withColumn("v", F.nullif("v", F.lit("c"))), GATES)
    dies = two.withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        v.publish(dies, GATES)
    assert rows_of(v.current()) == [(1, "a"), (2, "b")] and len(v.manifests()) == 1
    v.publish(two, GATES)
    assert rows_of(v.current()) == rows_of(two)
    v.roll_back()
    assert rows_of(v.current()) == rows_of(one)
    v.roll_back()
    assert rows_of(v.current()) == rows_of(two) and len(v.manifests()) == 4
    v.sweep()
    assert rows_of(v.current()) == rows_of(two) and len([n for n in os.listdir(f"{folder}/t") if n.startswith("v-")]) == 2
    with pytest.raises(ValueError, match="no version"):
        Versions(spark, f"{folder}/u").roll_back()


def test_two_publishers_can_not_both_win(spark, folder):
    v = Versions(spark, f"{folder}/t")
    table = spark.createDataFrame([(1, "a")], "k long, v string")
    v.publish(table, [])
    seen = v.latest()
    v.publish(table, [])
    with pytest.raises(RuntimeError, match="meanwhile"):
        v.commit({"version": "v-x"}, seen)


def test_stopped_backfill_resumes_without_reading_finished_files_again(spark, folder):
    source = f"{folder}/source"
    rows = [(i, None if i % 3 == 0 else f"n{i}", f" Name {i} ") for i in range(100)]
    spark.createDataFrame(rows, "k long, norm string, name string").repartition(7).write.parquet(source)
    fill = lambda df: df.withColumn("norm", F.concat(F.lit("n"), F.regexp_extract("name", r"(\d+)", 1)))
    lacking = F.col("norm").isNull()
    whole = backfill(spark, source, f"{folder}/whole", lacking, fill, files=3)
    assert rows_of(whole) == [(i, f"n{i}", f" Name {i} ") for i in range(100)]
    assert backfill(spark, source, f"{folder}/parts", lacking, fill, files=2, most=0) is None
    first = backfill(spark, source, f"{folder}/parts", lacking, fill, files=2, most=2)
    assert 0 < first.count() < 100
    finished = {f for b in Versions(spark, f"{folder}/parts").latest()["batches"].values() for f in b}
    assert len(finished) == 4
    for f in finished:
        os.remove(f.removeprefix("file://"))
    again = backfill(spark, source, f"{folder}/parts", lacking, fill, files=2)
    assert rows_of(again) == rows_of(whole)
    assert rows_of(backfill(spark, source, f"{folder}/parts", lacking, lambda df: df.where("raise_error('read again') IS NULL"), files=2)) == rows_of(whole)


def test_batches_sent_again_have_the_same_ids(spark, folder):
    table = spark.createDataFrame([(i % 50, f"v{i}") for i in range(230)], "k long, v string").repartition(5)

    def send(batch_id: str, rows: pd.DataFrame) -> None:
        with open(f"{folder}/{batch_id}", "w") as f:
            f.write(rows.to_json(orient="values"))

    sent = [sorted(tuple(r) for r in sent_in_batches(table.repartition(n), ["k"], send, size=20).collect()) for n in (2, 9)]
    assert sent[0] == sent[1] and sum(n for _, n in sent[0]) == 230 and max(n for _, n in sent[0]) == 20
    assert sorted(os.listdir(folder)) == sorted({i for i, _ in sent[0]})
    stored = [tuple(r) for i, _ in sent[0] for r in pd.read_json(f"{folder}/{i}").to_numpy().tolist()]
    assert sorted(stored) == rows_of(table)
    assert sent_in_batches(table.limit(0), ["k"], send).collect() == []
