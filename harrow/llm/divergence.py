"""How far the words of each source of a language are from other sources' and from the language's, by sums over shards of terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import materialise, portions

#: A-Z lower-cased, all other ASCII characters but a-z made blank; bytes from 0x80 on stay.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Probabilities are whole numbers of this part of one.
SCALE = 1_000_000_000

PART_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
PART_DDL = "lang string, source string, term string, n long, docs long"
COUNT_DDL = "lang string, source string, term string, n long, first boolean"
SUM_DDL = "kind string, lang string, source string, item string, p long, value decimal(38,0)"

#: Rows of the same group and term as one; done now and then, so that a task holds its distinct rows only.
MERGE_SQL = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM part GROUP BY ALL"
#: Counts of the terms that enough documents have, one of each term's rows marked, and a row without term for each group.
COUNT_SQL = """
    SELECT lang, source, term, n, row_number() OVER (PARTITION BY lang, term) = 1 AND term IS NOT NULL AS first FROM part
    QUALIFY term IS NULL OR sum(docs) OVER (PARTITION BY lang, term) >= {min_docs}
"""
#: For one shard. p: the share of a group's term; p0: of the group's terms that don't occur; q: of the language's term. ``pair``: over terms
#: that both groups have, what they add beyond the sums in which a term is absent from either group. ``share``: how many terms
#: of a group have p, for those sums. ``term``: the first terms by their value.
SUM_SQL = """
    WITH one AS (
        SELECT lang, term, source, {p} AS p, {p0} AS p0, {q} AS q FROM part),
    term AS (
        SELECT lang, source, term, (p - q) * (p - q) // q AS value FROM one WHERE p > q
        QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}),
    pair AS (
        SELECT a.lang, a.source, b.source AS item,
               sum((a.p - b.p) * (a.p - b.p) // b.p) - sum((a.p - b.p0) * (a.p - b.p0) // b.p0)
               - sum((a.p0 - b.p) * (a.p0 - b.p) // b.p) + sum((a.p0 - b.p0) * (a.p0 - b.p0) // b.p0) AS value
        FROM one a JOIN one b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
        GROUP BY ALL)
    SELECT 'term' AS kind, lang, source, term AS item, NULL::BIGINT AS p, value::DECIMAL(38,0) AS value FROM term
    UNION ALL SELECT 'pair', lang, source, item, NULL, value::DECIMAL(38,0) FROM pair
    UNION ALL SELECT 'share', lang, source, NULL, p, count(*)::DECIMAL(38,0) FROM one GROUP BY ALL
"""


def share_sql(count: str, total: str) -> str:
    """p = 1 + floor(SCALE * (count + 1) / (total + types)), in 128 bits until it is divided."""
    return f"(1 + ({SCALE}::HUGEINT * (({count})::HUGEINT + 1)) // (({total})::HUGEINT + types))::BIGINT"


def counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, of about ``most`` different terms of groups at a time."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for part in portions(batches, "text"):
        texts = pc.cast(part.column("text"), pa.binary())
        groups = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)
        for at, group in enumerate(groups):
            occurrences, documents = held.setdefault(group, (Counter(), Counter()))
            words = texts[at].as_py().translate(FOLD).split(b" ")
            before = len(documents)
            occurrences.update(words)
            documents.update(set(words))
            size += len(documents) - before
            if size >= most:
                yield from _flushed(held)
                held, size = {}, 0
    yield from _flushed(held)


def _flushed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (occurrences, documents) in held.items():
        occurrences.pop(b"", None)
        documents.pop(b"", None)
        terms, n = [None, *occurrences], len(occurrences) + 1
        columns = [
            pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
            pa.array([0, *occurrences.values()], pa.int64()), pa.array([1, *(documents[t] for t in occurrences)], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=PART_SCHEMA)


def in_shard(sql: str, merge: str | None = None, most: int = 1 << 20):  # noqa: ANN201
    """A map of a shard's rows, as table ``part``, through SQL; with ``merge``, whenever ``most`` more rows have come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})
        held: list[pa.RecordBatch] = []
        fresh = 0

        def done(text: str) -> pa.Table:
            con.register("part", pa.Table.from_batches(held))
            return con.sql(text).to_arrow_table()

        for batch in batches:
            held.append(batch)
            fresh += batch.num_rows
            if merge and fresh >= most:
                held, fresh = done(merge).to_batches(), 0
        if held:
            if merge:
                held = done(merge).to_batches()
            yield from done(sql).to_batches(max_chunksize=1 << 16)
        con.close()

    return run


def excess(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) of two 64-bit columns, whose squares are below 2^63."""
    return F.expr(f"cast(((({p}) - ({q})) * (({p}) - ({q}))) div ({q}) as decimal(20,0))")


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, shard_rows: int = 500_000, most: int = 250_000) -> DataFrame:
    """lang, source, part, item, value and rank: how each source of a language differs from its other sources and from the language.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps those in ``min_docs`` of its
    documents. With V kept terms and N occurrences of them in a group, p = 1 + floor(10^9 * (count + 1) / (N + V)), and
    f = floor((p - q)^2 / q). ``pair``: for each other source of the language, with its p as q, f summed over all kept terms.
    ``term``: for kept terms of the group with p > q, the language's p, f; the first ``top``. All arithmetic is exact.
    Ranks count from 1, value descending, then item by its UTF-8 bytes.

    Null lang, source and text count as empty ones, which are a language, a source and a text as others are. A row is a
    document, so repeated rows count each. A language without kept terms gives pairs of value 0 and no terms; a language with
    one source gives no pairs; an empty table gives no rows; other columns are left out; texts are read whole.

    Each task counts its documents' terms and passes on a row for each ``most`` different terms of groups. Rows are dealt by hash
    of lang and term to shards of about ``shard_rows``, in which SQL adds them up: so a frequent term is a row per group. Once Spark has
    the sums N and V, the counts are dealt to shards again, in which SQL works out the sums over terms that two groups share,
    how many terms of a group have each p, and the first terms. For terms that one group of a pair has, or none, no row is made:
    Spark adds them from the counts of p. Nothing is broadcast but what Spark itself finds small, and no source is one task's.
    """
    words = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = materialise(words.mapInArrow(lambda batches: counted(batches, most), PART_DDL), "terms")
    shards = _shards(parts, shard_rows)
    merged = parts.repartition(shards, "lang", "term").mapInArrow(in_shard(COUNT_SQL.format(min_docs=int(min_docs)), MERGE_SQL), COUNT_DDL)
    counts = materialise(merged, "term-counts")

    lang = Window.partitionBy("lang")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("own_types"))
    totals = totals.select("lang", "source", "total", F.sum("total").over(lang).alias("lang_total"), F.sum("own_types").over(lang).alias("types"))
    totals = materialise(totals.withColumn("p0", F.when(F.col("types") > 0, F.expr(f"1 + {SCALE} div (total + types)"))), "term-totals")

    kept = counts.where("term IS NOT NULL").drop("first").join(totals.drop("p0"), ["lang", "source"])
    sql = SUM_SQL.format(p=share_sql("n", "total"), p0=share_sql("0", "total"), q=share_sql("sum(n) OVER (PARTITION BY lang, term)", "lang_total"), top=int(top))
    sums = materialise(kept.repartition(_shards(counts, shard_rows), "lang", "term").mapInArrow(in_shard(sql), SUM_DDL), "term-sums")

    pairs = _pairs(totals, sums)
    terms = sums.where("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", F.col("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)), terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)]
    return ranked[0].unionByName(ranked[1])


def _shards(table: DataFrame, rows: int) -> int:
    """So many that a shard has about ``rows`` rows of a written table, and no fewer than Spark's own number."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // rows))


def _pairs(totals: DataFrame, sums: DataFrame) -> DataFrame:
    """The sum over all kept terms for each two groups of a language.

    It is V * f(p0, q0), and for each term of the one group f(p, q0) - f(p0, q0), and for each of the other f(p0, q) - f(p0, q0), and
    what the shards have for terms of both.
    """
    others = totals.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    both = totals.join(others, "lang").where("source <> other")
    none = both.select("lang", "source", F.col("other").alias("item"), F.when(F.col("types") > 0, excess("p0", "q0") * F.col("types").cast("decimal(17,0)")).otherwise(0).cast("decimal(38,0)").alias("value"))
    shares = sums.where("kind = 'share'").groupBy("lang", "source", "p").agg(F.sum("value").cast("decimal(17,0)").alias("n"))
    one = shares.join(totals, ["lang", "source"]).join(others, "lang").where("source <> other")
    one = one.groupBy("lang", "source", "other").agg(
        F.sum(F.col("n") * (excess("p", "q0") - excess("p0", "q0")).cast("decimal(20,0)")).cast("decimal(38,0)").alias("first"),
        F.sum(F.col("n") * (excess("q0", "p") - excess("q0", "p0")).cast("decimal(20,0)")).cast("decimal(38,0)").alias("second"),
    )
    parts = [
        none,
        one.select("lang", "source", F.col("other").alias("item"), F.col("first").alias("value")),
        one.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), F.col("second").alias("value")),
        sums.where("kind = 'pair'").select("lang", "source", "item", "value"),
    ]
    added = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    summed = added.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
