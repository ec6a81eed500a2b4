"""Batch rankings, soil by depth, last known rows, plan lifecycles and change feeds, against plain Python and on odd rows."""

from __future__ import annotations

import json
import math
import tempfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harrow.operators import changes as G
from harrow.operators import lifecycle as L
from harrow.operators.asof import last_before
from harrow.operators.nearby import nearest_sites
from harrow.operators.soils import available_water, first_horizon, range_means

SITE = "site_id long, name string, climate_class string, rainfall double, et0 double, frost_days double, elevation double"
TARGET = "target_id long, rainfall double, et0 double, frost double, elevation double, climate_class string"


def plain_nearest(target: tuple, sites: list[tuple], k: int) -> list[tuple]:
    """(site_id, distance) of a target's nearest sites over all sites."""
    vector = lambda r, e, f, h: None if None in (r, e, f, h) or e == 0 else (r / e, r, f, h)
    known = [v for s in sites if (v := vector(*s[3:]))]
    _, rain, et0, frost, height, climate = target
    mine = vector(rain, et0, frost, height)
    found = []
    for site, name, c, *figures in sites:
        theirs = vector(*figures)
        if mine and theirs:
            total = 0.0
            for i, w in enumerate((2.0, 1.0, 1.0, 0.5)):
                span = max(*(v[i] for v in known), mine[i]) - min(*(v[i] for v in known), mine[i])
                total += w * ((theirs[i] - mine[i]) / span) ** 2 if span > 0 else 0.0
            found.append((round(math.sqrt(total / 4.5), 4), name, site))
        elif climate and c == climate and None not in (rain, figures[0]) and abs(figures[0] - rain) <= 200:
            found.append((2.0 if mine else None, name, site))
    found.sort(key=lambda x: (x[0] is not None, x[0] or 0.0, *x[1:]))
    return [(site, d) for d, _, site in found[:k]]


def test_nearest_sites_of_many_targets_equal_all_pairs(spark):
    random = np.random.default_rng(3)
    sites = [(i, f"s{i % 40}", "ABC"[i % 3], *random.uniform([200, 600, 0, 0], [1200, 1500, 90, 2000]).round(1).tolist()) for i in range(300)]
    sites += [(300 + i, "same", "A", 500.0, 1000.0, 20.0, 300.0) for i in range(80)]  # a crowded cell
    sites += [(400, "bare", "A", 450.0, None, 1.0, 1.0), (401, "bare", "B", 900.0, 0.0, 1.0, 1.0), (402, "bare", None, None, None, None, None)]
    targets = [(i, *random.uniform([200, 600, 0, 0], [1200, 1500, 90, 2000]).round(1).tolist(), "ABC"[i % 3]) for i in range(40)]
    targets += [(50, 9000.0, 300.0, 500.0, 9000.0, "A"), (51, 1.0, 3000.0, -50.0, -10.0, None), (52, None, 900.0, 10.0, 10.0, "A"), (53, 500.0, None, 10.0, 10.0, "A"), (54, 500.0, 1000.0, 20.0, 300.0, "A"), (55, 500.0, 0.0, 20.0, 300.0, None)]
    for k in (1, 5, 90):
        got: dict = {}
        for r in sorted(nearest_sites(spark.createDataFrame(targets, TARGET), spark.createDataFrame(sites, SITE), k).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.target_id, []).append((r.site_id, r.distance))
        assert got == {t[0]: n for t in targets if (n := plain_nearest(t, sites, k))}
    few, none = spark.createDataFrame(targets[:2], TARGET), spark.createDataFrame(sites, SITE).limit(0)
    assert nearest_sites(few, none, 3).collect() == [] and nearest_sites(few.limit(0), spark.createDataFrame(sites, SITE), 3).collect() == []


def test_depth_ranges_with_gaps_overlaps_and_missing_bounds(spark):
    horizon = "parcel_id long, depth_from double, depth_to double, ph double, organic_carbon double, field_capacity double, wilting_point double"
    rows = [
        (1, None, 10.0, 6.0, 2.0, 0.3, 0.1), (1, 20.0, 40.0, 8.0, -9999.0, 0.3, None), (1, 30.0, 60.0, -9999.0, 1.0, 0.2, 0.1), (1, 70.0, None, 5.0, 5.0, 0.3, 0.1),
        (1, 50.0, 50.0, 1.0, 1.0, 0.3, 0.1), (2, 5.0, 5.5, 7.0, None, None, 0.1),
    ]
    asked = [(1, 0, 30), (1, 30, 50), (1, 60, 90), (1, 8, 8), (2, 0, 100), (3, 0, 10), (1, 0, 30)]
    h, a = spark.createDataFrame(rows, horizon), spark.createDataFrame(asked, "parcel_id long, top int, bottom int")
    got = {(r.parcel_id, r.top): (r.ph, r.organic_carbon, r.covered) for r in range_means(h, a, ["ph", "organic_carbon"]).collect()}
    assert got == {(1, 0): (7.0, 2.0, 20.0), (1, 30): (8.0, 1.0, 20.0), (1, 60): (None, None, 0.0), (1, 8): (None, None, 0.0), (2, 0): (7.0, None, 0.5), (3, 0): (None, None, 0.0)}
    assert {r.parcel_id: r.awc_mm for r in available_water(h).collect()} == {1: 50.0, 2: None}
    assert {r.parcel_id: (r.depth_from, r.depth_to, r.ph, r.organic_matter_pct) for r in first_horizon(h).collect()} == {1: (0.0, 10.0, 6.0, 3.45), 2: (5.0, 5.5, 7.0, None)}
    assert range_means(h, a.limit(0), ["ph"]).collect() == [] and range_means(h.limit(0), a, ["ph"]).count() == 6


def test_last_known_row_before_each_moment(spark):
    start = datetime(2020, 1, 1)
    random = np.random.default_rng(5)
    days = lambda n: [start + timedelta(days=int(x)) for x in random.integers(-400, 900, n)]
    known = [(i, None if i % 37 == 0 else "hot" if i % 3 else f"k{i % 20}", t, float(i) if i % 5 else None) for i, t in enumerate(days(600))] + [(900, "hot", None, 1.0)]
    moments = [(i, None if i % 41 == 0 else "hot" if i % 2 else f"k{i % 25}", t) for i, t in enumerate(days(300))] + [(900, "hot", None), (901, "hot", None)]
    k = spark.createDataFrame(known, "row_id long, key string, ts timestamp, value double").repartition(5)
    m = spark.createDataFrame(moments, "moment_id long, key string, ts timestamp").repartition(3)
    for span in (7, 30, 4000):
        got = {r.moment_id: r.last and (r.last.row_id, r.last.value) for r in last_before(m, k, ["key"], "ts", "row_id", span_days=span).collect()}
        expected = {}
        for i, key, ts in moments:
            before = [(t, n, v) for n, c, t, v in known if t and ts and c == key and key and t < ts]
            expected[i] = max(before, key=lambda x: x[:2])[1:] if before else None
        assert got == expected
    assert last_before(m.limit(0), k, ["key"], "ts", "row_id").collect() == [] and last_before(m, k.limit(0), ["key"], "ts", "row_id").where("last IS NOT NULL").collect() == []


LOG = "parcel_id long, season string, seq int, event_id long, ts timestamp, action string, method string"


def some_events(n: int) -> list[tuple]:
    random = np.random.default_rng(n)
    pick = lambda *of: of[random.integers(len(of))]
    start = datetime(2024, 1, 1)
    return [
        (pick(1, 1, 1, 2, 3), pick("a", "b"), pick(0, 1, 2), i, start + timedelta(hours=i // 3), pick("plan", "advance", "advance", "finish", "clear", "graft", None), pick("harvest", "grazing", None))
        for i in range(n)
    ]


def state_of(rows: list) -> tuple[set, set]:
    segments = {(r.parcel_id, r.season, r.seq, r.status, r.method, r.planted, r.ended) for r in rows if r.kind == "segment"}
    return segments, {(r.event_id, r.reason) for r in rows if r.kind == "refused"}


def test_plan_moves(spark):
    t = [datetime(2024, 3, d) for d in range(1, 10)]
    log = [
        (7, "s", 0, 1, t[0], "plan", "harvest"), (7, "s", 1, 2, t[0], "plan", "grazing"), (7, "s", 0, 3, t[1], "advance", None), (7, "s", 1, 4, t[2], "advance", None), (7, "s", 0, 5, t[3], "advance", None),
        (7, "s", 1, 6, t[4], "finish", None), (7, "s", 2, 7, t[5], "advance", None), (7, "s", 3, 8, t[5], "plan", None), (7, "s", 3, 9, t[6], "clear", None), (7, "s", 3, 10, t[7], "graft", None),
        (7, None, 3, 11, t[7], "plan", None), (7, "s", None, 12, t[7], "plan", None),
    ]
    segments, refused = state_of(L.plan_outcomes(spark.createDataFrame(log, LOG).repartition(3)).collect())
    assert segments == {(7, "s", 0, "harvested", "harvest", t[1], t[2]), (7, "s", 1, "terminated", "grazing", t[2], t[4]), (7, "s", 3, "cleared", None, None, None)}
    assert refused == {(5, "segment is harvested"), (7, "segment is missing"), (10, "unknown action"), (11, "incomplete"), (12, "incomplete")}
    assert L.plan_outcomes(spark.createDataFrame([], LOG)).collect() == []


def test_plan_stream_equals_table(spark):
    events = some_events(120)
    folder, out = tempfile.mkdtemp(prefix="spark-"), []
    frame = pd.DataFrame(events, columns=[c.split()[0] for c in LOG.split(", ")])
    for part in range(3):  # three micro-batches in the order of time
        with open(f"{folder}/{part}.json", "w") as f:
            for r in frame.iloc[part * 40 : part * 40 + 40].to_dict("records"):
                f.write(json.dumps({k: v for k, v in (r | {"ts": r["ts"].isoformat()}).items() if v is not None}) + "\n")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = L.plan_stream(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(folder))
        query = stream.writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(lambda df, i: out.append((i, df.collect()))).start()
        assert query.awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    latest, refused = {}, set()
    for _, rows in sorted(out, key=lambda x: x[0]):
        for r in rows:
            if r.kind == "segment":
                latest[r.parcel_id, r.season, r.seq] = (r.status, r.method, r.planted, r.ended)
            else:
                refused.add((r.event_id, r.reason))
    table, reasons = state_of(L.plan_outcomes(spark.createDataFrame(events, LOG)).collect())
    assert {(*k, *v) for k, v in latest.items()} == table and refused == reasons


def test_change_feed_in_any_order(spark):
    ddl = "uri long, part string, kc double"
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0), (4, None, 4.0)], ddl)
    new = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (4, None, 4.0), (5, "e", None)], ddl)
    feed = G.changes(old, new, ["uri"], 2, unchanged=True)
    assert {(r.uri, r.kind) for r in feed.collect()} == {(1, "same"), (2, "update"), (3, "delete"), (4, "same"), (5, "insert")}
    first = G.changes(old.limit(0), old, ["uri"], 1)
    empty = first.select("uri", "row", F.lit(False).alias("deleted"), "version").limit(0)
    orders = [(first, feed), (feed, first), (first, feed, feed, first), (first.unionByName(feed),)]
    for order in orders:
        catalogue = empty
        for part in order:
            catalogue = G.applied(catalogue, part, ["uri"])
        rows = {(r.uri, r.row and tuple(r.row), r.deleted, r.version) for r in catalogue.collect()}
        assert rows == {(1, ("a", 1.0), False, 1), (2, ("b", 2.0), False, 2), (3, None, True, 2), (4, (None, 4.0), False, 1), (5, ("e", None), False, 2)}
        assert {tuple(r) for r in G.live(catalogue, ["uri"]).collect()} == {tuple(r) for r in new.collect()}


def test_crop_entities_as_records(spark):
    ddl = "uri string, name string, scientific_name string, provider string, kc_ini double, kc_mid double, kc_end double, kc_source string, heat_c double, frost_c double, thermal_source string, varieties array<string>"
    rows = [("a", "n", None, "p", 0.3, None, 0.0, None, 35.0, None, None, ["x", "y", "x", None]), ("b", None, None, None, None, 1.0, 1.0, "s", 0.0, None, "t", None)]
    df = spark.createDataFrame(rows, ddl)
    a, b = sorted(G.crop_records(df).collect())
    assert (a.kc_ini, a.kc_mid, a.kc_end, a.kc_source, a.heat_c, a.thermal_source) == (0.3, 0.3, 0.3, "Unknown", 35.0, "derived")
    assert (b.kc_mid, b.kc_source, b.heat_c, b.frost_c, b.thermal_source) == (None, None, None, None, "t")
    assert sorted(tuple(r) for r in G.sub_crops(df).collect()) == [("a", "x"), ("a", "y")]


def plain_rotations(parcel: tuple, figures: dict, follows: set, weights: dict, locks: dict, years: int, gap: int, cost: float) -> tuple:
    """(score, crops) of the best of all rotations of a parcel."""
    _, zone, previous, cover = parcel
    dims = ("protein", "carbon", "n_fixation", "margin", "yield")
    pool = {c: f for (z, c), f in figures.items() if z == zone}
    plans = [(0.0, [], 50.0, previous)]
    for year in range(1, years + 1):
        after = []
        for score, crops, soil, last in plans:
            named = [c for c in pool if (last, c) in follows and c != last]
            options = named or [c for c in pool if c != last]
            top = {d: max([pool[c][d] for c in options if pool[c][d] > 0], default=1.0) for d in dims}
            if year in locks:
                options = [c for c in [locks[year]] if c in pool]
            for c in options:
                if year not in locks and c in crops[len(crops) - gap :][-gap:]:
                    continue
                gain = 0.0 if year in locks else round(sum(w * max(pool[c][d], 0.0) / top[d] for d, w in weights[year].items()) + 1e-9, 1)
                left = soil + pool[c]["n_fixation"] - pool[c]["need"]
                after.append((round(score + gain - cost * max(0.0, -left), 6), [*crops, c], round(max(0.0, left) + (cover or 0.0), 3), c))
        plans = after
    return min(((-p[0], p[1]) for p in plans), default=None)


def test_rotation_search_equals_all_rotations(spark):
    from harrow.operators.rotations import DIMENSIONS, best_rotations

    random = np.random.default_rng(9)
    crops = ["bean", "corn", "oats", "rape", "rye"]
    figures = [(z, c, *random.uniform(-20, 90, 4).round(1).tolist(), float(random.integers(1, 9)), float(random.integers(20, 90))) for z in "AB" for c in crops]
    follows = {("bean", "corn"), ("bean", "rye"), ("bean", "oats"), ("corn", "bean"), ("corn", "oats"), ("rye", "rape"), ("rye", "bean"), ("oats", "wheat")}
    weights = [(1, 1.0, 2.0, 3.0, 1.0, 1.0), (3, 0.0, 0.0, 1.0, None, 3.0)]
    parcels = [(i, "ABC"[int(random.integers(3)) if i % 9 == 0 else i % 2], [None, "bean", "fallow", "rye"][i % 4], [None, 10.0, 33.5][i % 3]) for i in range(200)]
    locks = {i: {2: "rye"} if i % 5 else {1: "corn", 4: "wheat" if i % 10 else "corn"} for i in range(0, 200, 3)}
    frames = (
        spark.createDataFrame(parcels, "parcel_id long, zone string, previous string, cover_n double"),
        spark.createDataFrame(figures, "zone string, crop string, " + ", ".join(f"{d} double" for d in DIMENSIONS) + ", n_requirement double"),
        spark.createDataFrame(sorted(follows), "previous string, crop string"),
        spark.createDataFrame(weights, "year_no int, " + ", ".join(f"{d} double" for d in DIMENSIONS)),
        spark.createDataFrame([(i, y, c) for i, l in locks.items() for y, c in l.items() if c in crops], "parcel_id long, year_no int, crop string"),
    )
    table = {(f[0], f[1]): dict(zip((*DIMENSIONS, "need"), f[2:], strict=True)) for f in figures}
    share = lambda row: {d: (w or 0.0) / sum(x or 0.0 for x in row) * 100 for d, w in zip(DIMENSIONS, row, strict=True)}
    by_year = {y: share(weights[1 if y == 3 else 0][1:]) for y in range(1, 5)}
    got = {r.parcel_id: (-r.score, r.crops) for r in best_rotations(*frames, years=4, beam=5000, gap=2, shortage_cost=0.7).collect()}
    expected = {}
    for p in parcels:
        known = {y: c for y, c in locks.get(p[0], {}).items() if c in crops}
        if best := plain_rotations(p, table, follows, by_year, known, 4, 2, 0.7):
            expected[p[0]] = best
    assert {i: round(v[0], 3) for i, v in got.items()} == {i: round(v[0], 3) for i, v in expected.items()}
    assert sum(got[i][1] == v[1] for i, v in expected.items()) > 0.99 * len(expected)
    narrow = {r.parcel_id: r.score for r in best_rotations(*frames, years=4, gap=2, shortage_cost=0.7).collect()}
    assert narrow.keys() <= expected.keys() and all(s <= -expected[i][0] + 1e-6 for i, s in narrow.items())
    with pytest.raises(ValueError, match="two to six"):
        best_rotations(*frames, years=7)


@pytest.mark.parametrize("name", ["nearest_sites_of_parcels", "extrapolate_for_parcels", "plan_lifecycle"])
def test_queries_at_a_larger_scale(spark, name):
    from harrow.catalog import ORACLE_SQL, QUERIES
    from tests.oracle import spark_rows, sql_rows

    folder = "/root/testdata/sf0.01"
    assert spark_rows(QUERIES[name](spark, folder)) == sql_rows(ORACLE_SQL[name], folder)
