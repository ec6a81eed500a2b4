"""Exact deduplication: sorted runs of text digests, merged in binomial rounds."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import BLANKS, materialise, numbered

#: Runs that one node merges in a round; slices of a run are cut by powers of it, so that coarser ones hold finer ones.
FAN_IN = 8
#: A key: SHA-256 of the bare text, then its 64-bit check and its length, which verify that equal digests are equal texts.
KEY = "S48"

RUN = pa.schema([(c, pa.int64()) for c in ("run", "slice")] + [(c, pa.binary()) for c in ("keys", "size", "longest", "no_id", "doc_id", "row_id")])
RUN_DDL = "run long, slice long, keys binary, size binary, longest binary, no_id binary, doc_id binary, row_id binary"
OUT = pa.schema([("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("kept", pa.bool_()), ("text_sha256", pa.string()), ("row_id", pa.int64())])
OUT_DDL = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, row_id long"

#: Of a group: how many rows it has, and the row that stays (code points, whether it has no id, id, row).
FIELDS = ("size", "longest", "no_id", "doc_id", "row_id")


class Run:
    """Sorted distinct keys with the fields of each group."""

    def __init__(self, keys: np.ndarray, fields: dict[str, np.ndarray]):
        self.keys, self.fields = keys, fields

    @classmethod
    def of_slices(cls, rows: list[dict]) -> Run:
        rows = sorted(rows, key=lambda r: r["slice"])
        keys = np.frombuffer(b"".join(r["keys"] for r in rows), KEY)
        return cls(keys, {f: np.frombuffer(b"".join(r[f] for r in rows), "<i8") for f in FIELDS})

    def slices(self, number: int, finest: int) -> Iterator[tuple]:
        """A row per slice of the key space; there are FAN_IN ** ``finest`` of them, and empty ones are left out."""
        heads = self.keys.view(np.uint8).reshape(len(self.keys), -1)[:, :8].copy().view(">u8").reshape(-1).astype(np.uint64)
        own = (heads >> np.uint64(64 - 3 * finest)).astype(np.int64) if finest else np.zeros(len(heads), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield number, int(own[a]), self.keys[a:b].tobytes(), *(self.fields[f][a:b].astype("<i8").tobytes() for f in FIELDS)


def leaf_run(table: pa.Table) -> Run:
    """The run of one input partition: each key with its number of rows and the first by rank."""
    n_chars, doc_id, row_id = (table.column(c).to_numpy(zero_copy_only=False) for c in ("n_chars", "known_id", "row_id"))
    no_id = table.column("no_id").to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.frombuffer(b"".join(table.column("key").to_pylist()), KEY)
    order = np.lexsort((row_id, doc_id, no_id, -n_chars))
    order = order[np.argsort(keys[order], kind="stable")]
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    best = order[first]
    size = np.diff(np.concatenate((first, [len(order)])))
    return Run(keys[best], {"size": size, "longest": n_chars[best].astype(np.int64), "no_id": no_id[best], "doc_id": doc_id[best], "row_id": row_id[best]})


def merged(runs: list[Run]) -> Run:
    """Multiway merge: the runs' keys in order; equal ones become one, with the sum of the sizes and the row that ranks first."""
    keys: list[bytes] = []
    best: list[tuple] = []
    sizes: list[int] = []
    ranked = [list(zip((-r.fields["longest"]).tolist(), *(r.fields[f].tolist() for f in FIELDS[2:]), strict=True)) for r in runs]
    counts = [r.fields["size"].tolist() for r in runs]
    heads = (zip(r.keys.tolist(), repeat(i), range(len(r.keys))) for i, r in enumerate(runs))
    for key, i, j in heapq.merge(*heads):
        if keys and keys[-1] == key:
            sizes[-1] += counts[i][j]
            best[-1] = min(best[-1], ranked[i][j])
        else:
            keys.append(key)
            sizes.append(counts[i][j])
            best.append(ranked[i][j])
    columns = np.array(best, np.int64).reshape(len(best), 4)
    fields = {"size": np.array(sizes, np.int64), "longest": -columns[:, 0]} | {f: columns[:, n] for n, f in enumerate(FIELDS[2:], 1)}
    return Run(np.array(keys, KEY), fields)


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(RUN)
    return pa.table([pa.array(c, t) for c, t in zip(columns, RUN.types, strict=True)], schema=RUN)


def _merge(cut: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return _table(list(merged([Run.of_slices([r]) for r in table.to_pylist()]).slices(key[0].as_py(), cut)))

    return merge


def _down(parents: pa.Table, children: pa.Table) -> pa.Table:
    """The children's runs with the fields that their keys have in the parent's run."""
    if not len(parents) or not len(children):
        return _table([])
    up = Run.of_slices(parents.to_pylist())
    out = []
    for child in children.to_pylist():
        at = np.searchsorted(up.keys, np.frombuffer(child["keys"], KEY))
        out.append((child["run"], child["slice"], child["keys"], *(up.fields[f][at].tobytes() for f in FIELDS)))
    return _table(out)


def exact_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row_id: str | None = None, slice_rows: int = 100_000
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row_id.

    Texts are equal when identical after deleting white space (space, 0x09-0x0D); null counts as empty, so
    null, empty and blank texts form one group. Of equal texts the row stays that has most code points in the
    original text, then the smallest doc_id (null last), then the first row by position (or by the column ``row_id``):
    of repeated rows exactly one stays. An empty table gives no rows; other columns are left out; whole texts count.

    Each input partition makes a sorted run of its distinct digests. In each round :data:`FAN_IN` neighbouring runs are merged
    into one, until one is left; then its verdicts go back down the same tree by sorted search. A run is cut into slices of
    the key space of about ``slice_rows`` keys, which are merged by tasks of their own, so that no task holds a whole
    run. A text that makes up a third of all rows is one entry of a run at every level, so it burdens no task; its rows
    meet the verdict in their own input partitions.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bare = F.translate(whole, BLANKS, "")
    number = F.col(doc_id).cast("long")
    rows = docs.select(
        number.alias("doc_id"), F.length(whole).alias("n_chars"), bare.alias("bare"), F.spark_partition_id().cast("long").alias("run"),
        (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("row_id"),
    )
    eight = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))
    key = F.concat(F.unhex(F.sha2("bare", 256)), eight(F.xxhash64("bare")), eight(F.octet_length("bare")))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("known_id"), F.col("doc_id").isNull().alias("no_id"), "n_chars", "run", "row_id", key.alias("key"))
    rows = materialise(rows, "digests")
    count, last = rows.agg(F.count(F.lit(1)), F.max("run")).first()
    rounds = 0
    while last is not None and FAN_IN**rounds <= last:
        rounds += 1
    each = count / ((last or 0) + 1)

    def finest(level: int) -> int:
        """Runs of a level are cut into FAN_IN to this power slices, for the round that merges them."""
        power = 0
        while FAN_IN**power * slice_rows < each * FAN_IN ** (level + 1):
            power += 1
        return min(power, 20)

    def leaf(key: tuple, table: pa.Table) -> pa.Table:
        return _table(list(leaf_run(table).slices(key[0].as_py(), finest(0))))

    levels = [materialise(rows.groupBy("run").applyInArrow(leaf, RUN_DDL), "runs")]
    for level in range(1, rounds + 1):
        above = levels[-1].groupBy(F.expr(f"run div {FAN_IN}").alias("parent"), "slice").applyInArrow(_merge(finest(level)), RUN_DDL)
        levels.append(materialise(above, "runs"))
    verdicts = levels[-1]
    for level in range(rounds - 1, -1, -1):
        apart = FAN_IN ** (finest(level + 1) - finest(level))
        above = verdicts.groupBy(F.col("run").alias("parent"), F.expr(f"slice div {apart}").alias("part"))
        below = levels[level].groupBy(F.expr(f"run div {FAN_IN}").alias("parent"), F.col("slice").alias("part"))
        verdicts = above.cogroup(below).applyInArrow(_down, RUN_DDL)

    def answer(members: pa.Table, verdict: pa.Table) -> pa.Table:
        if not len(members):
            return OUT.empty_table()
        best = Run.of_slices(verdict.to_pylist())
        keys = members.column("key").to_pylist()
        at = np.searchsorted(best.keys, np.frombuffer(b"".join(keys), KEY))
        keep_id = pa.array(best.fields["doc_id"][at], mask=best.fields["no_id"][at].astype(bool))
        kept = best.fields["row_id"][at] == members.column("row_id").to_numpy()
        columns = [members.column("doc_id"), keep_id, pa.array(best.fields["size"][at]), pa.array(kept), pa.array([k[:32].hex() for k in keys]), members.column("row_id")]
        return pa.table(columns, schema=OUT)

    return rows.groupBy("run").cogroup(verdicts.groupBy("run")).applyInArrow(answer, OUT_DDL)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; same rules as :func:`exact_duplicates`."""
    rows, row = numbered(docs)
    kept = exact_duplicates(rows, row_id=row).where("kept").select(F.col("row_id").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
