"""Work that must not grow faster than what it is asked for."""

from __future__ import annotations

from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from harrow.operators import asof as L
from harrow.operators import crops as K
from harrow.operators import hygiene as H
from harrow.operators import nearby as N
from harrow.operators import prospects as P
from harrow.operators import rotations as R
from harrow.operators import sequences as Q
from harrow.operators import varieties as V
from harrow.plans import backtest as T
from harrow.sources.scratch import written


def join_rows(df) -> int:  # noqa: ANN001
    """Rows that the joins of a plan put out when it is run; tables written before aren't counted."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            total += node.metrics().apply("numOutputRows").value() if "Join" in name else 0
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


SPECIES = "crop_id long, name string, scientific_name string"


def test_equal_values_of_a_species_are_met_as_one(spark):
    asked = spark.createDataFrame([(i, "Oats", "late" if i % 2 else None) for i in range(200)], "ask_id long, name string, stage string")
    species = spark.createDataFrame([(1, "oats", "Avena sativa"), (2, "avena sativa", "oats")], SPECIES)
    values = spark.createDataFrame([(1 + v % 2, s, float(v % 4)) for v in range(80) for s in ("early", "late")], "crop_id long, stage string, n_uptake double")
    rows = P.by_species(asked, species, values, ["stage"], any_case=True)
    expected = Counter((i, "Oats", s, float(v % 4)) for i in range(200) for v in range(80) for s in (("late",) if i % 2 else ("early", "late")))
    assert rows.columns == ["ask_id", "name", "stage", "n_uptake"]
    assert Counter(tuple(r) for r in rows.collect()) == expected
    assert join_rows(rows) < 5000 < rows.count()


def test_copies_of_a_value_are_made_in_pieces_and_by_many_tasks(spark):
    asked = spark.createDataFrame([(i, "oats", "early" if i == 2 else None) for i in range(3)], "ask_id long, name string, stage string")
    species = spark.createDataFrame([(1, "oats", "Avena sativa")], SPECIES)
    values = spark.range(50_007).selectExpr("1L AS crop_id", "IF(id < 50000, 'early', NULL) AS stage", "IF(id < 50000, 0.5D, CAST(id AS DOUBLE)) AS n_uptake")
    rows = P.by_species(asked, species, values, ["stage"], any_case=True)
    assert rows.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    sums = rows.groupBy("ask_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_uptake").alias("s"), F.countDistinct("stage", "n_uptake").alias("d"), F.count_if(F.col("stage").isNull()).alias("null"))
    whole = (50_007, 25_000.0 + sum(range(50_000, 50_007)), 1, 7)  # values without a stage are met if none is asked for
    assert {tuple(r) for r in sums.collect()} == {(0, *whole), (1, *whole), (2, 50_000, 25_000.0, 1, 0)}
    assert 3 * 50 <= join_rows(rows) < 1000  # three who ask meet fifty pieces each, not one value of 50,000 copies


def test_first_value_is_found_before_names_meet_it(spark):
    asked = spark.createDataFrame([(i, "oats") for i in range(100)] + [(100, None), (101, "rye")], "ask_id long, name string")
    species = spark.createDataFrame([(1, "oats", "a"), (2, "oats", "b")], SPECIES)
    values = spark.createDataFrame([(1 + v % 2, f"S{v % 50:02}", v) for v in range(1000)], "crop_id long, source string, heat int")
    rows = P.by_species(asked, species, values, ["source", "heat"], first_only=True)
    assert sorted(tuple(r) for r in rows.collect()) == [(i, "oats", "S00", 0) for i in range(100)]
    assert join_rows(rows) < 1000


PLACE = "latitude double, longitude double"


def test_points_and_sites_of_one_place_meet_once(spark):
    points = spark.createDataFrame([(i, 40.5, -3.5) for i in range(300)] + [(300, None, 1.0), (301, 89.6, 10.0)], f"point_id long, {PLACE}")
    sites = spark.createDataFrame([(500 - i, 40.75, -3.5) for i in range(200)] + [(900, 89.6, 60.0)], f"site_id long, {PLACE}")
    rows = H.nearest_within(points, sites, 50.0)
    got = {r.point_id: (r.site_id, r.km) for r in rows.collect()}
    assert len(got) == 302 and all(got[i] == (301, 27.799) for i in range(300)) and got[300] == (None, None)
    assert got[301][0] == 900 and 30 < got[301][1] < 40  # by the pole, fifty degrees of longitude are near
    assert join_rows(rows) < 1000


def test_parcels_and_sites_of_one_place_meet_once(spark):
    parcels = spark.createDataFrame([(i, "[[-3.5, 40.5]]", "2", "drip", None) for i in range(300)], "parcel_id long, location string, area string, irrigation_system string, irrigation_regime string")
    sites = spark.createDataFrame([(i, "Csa" if i == 7 else "BSk", 40.75, -3.5) for i in range(7, 200)], f"site_id long, climate_class string, {PLACE}")
    rows = K.parcel_environment(parcels, sites)
    assert {(r.climate_class, r.site_km) for r in rows.collect()} == {("Csa", 27.799)} and rows.count() == 300
    assert join_rows(rows) < 1000


def test_links_are_distinct_without_a_shuffle_of_them(spark):
    trials = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, ""), (4, None)], "trial_id long, location_key string")
    sites = spark.createDataFrame([(10, "a", "b", "b"), (11, "a", None, ""), (10, "c", "b", None)], "site_id long, site_key string, municipality_key string, other_key string")
    rows = H.link_trials(trials, sites)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 10), (1, 11), (2, 10)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]  # nothing is grouped above the join


def test_targets_and_questions_that_are_alike_ask_once(spark, monkeypatch):
    tables = {}

    def kept(df, name):  # noqa: ANN001, ANN202
        tables.setdefault(name, []).append(df)
        return written(df, name)

    monkeypatch.setattr(N, "written", kept)
    monkeypatch.setattr(P, "written", kept)
    sites = spark.createDataFrame([(i, f"s{i % 3}", "Csa", "Vertisol", 400.0 + i % 4, 900.0, 10.0, 50.0) for i in range(40)], "site_id long, name string, climate_class string, soil_type string, rainfall double, et0 double, frost_days double, elevation double")
    targets = spark.createDataFrame([(i, 402.0, 900.0 if i % 2 else None, 12.0, 60.0, "Csa") for i in range(100)], "target_id long, rainfall double, et0 double, frost double, elevation double, climate_class string")
    near = N.nearest_sites(targets, sites, k=5)
    assert {(r.target_id % 2, r.rank, r.site_id) for r in near.collect()} == {(1, n, s) for n, s in enumerate((6, 18, 30, 10, 22), 1)} | {(0, n, s) for n, s in enumerate((0, 3, 6, 9, 12), 1)}
    trials = spark.createDataFrame([(f"t{i}", "oats", "WINTER A", 3000.0 + i, "high", 2026, {"rust": float(i % 3)}) for i in range(40)], "trial_id string, crop string, variety_norm string, yield_kg_ha double, confidence string, year int, scores map<string,double>")
    links = spark.createDataFrame([(f"t{i}", i) for i in range(40)], "trial_id string, site_id long")
    ranked = N.rank_for_targets(targets.selectExpr("target_id", "'oats' AS crop"), near, trials, links, 2026)
    assert ranked.count() == 100 and ranked.select("mean_yield", "trial_count").distinct().count() == 2
    asked = spark.createDataFrame([(i, "oats", "winter", "Csa", None, 50.0 + i) for i in range(100)], "ask_id long, crop string, variety string, climate_class string, soil_type string, utilisation_pct double")
    rows = P.yield_prospects(asked, trials.withColumn("traits", F.col("scores")), links, sites).collect()
    assert len(rows) == 100 and {(r.status, r.trials, r.expected_yield) for r in rows} == {("ok", 40, 3019.5)} and len({r.current_yield for r in rows}) == 100
    assert tables["near"][0].select("target_id").distinct().count() == 1 and tables["met"][0].select("target_id").distinct().count() == 2
    assert tables["yield-met"][0].count() == 1


def test_folds_of_one_environment_share_their_sums(spark, monkeypatch):
    tables = {}

    def kept(df, name):  # noqa: ANN001, ANN202
        tables.setdefault(name, []).append(df)
        return written(df, name)

    monkeypatch.setattr(T, "written", kept)
    rows = [(i, f"S{i % 30:02}", "Csa", 400.0, 900.0, 10.0, 50.0 if i < 55 else 60.0) for i in range(60)]
    sites = spark.createDataFrame(rows, "site_id long, name string, climate_class string, rainfall double, et0 double, frost_days double, elevation double")
    made = [(f"t{i}", f"V{i % 3}", 2026, 1000.0 + 7 * i, (i,)) for i in range(60)] + [("three", "V0", 2020, 9000.0, (3, 4, 8)), ("two", "V1", 2020, 100.0, (9, 10))]
    made += [("alone", "ONLY", 2026, 500.0, (2,)), ("old", "THIN", 1900, 123.0, (7,))] + [(f"new{i}", "THIN", 2026, 8000.0 + i, (5,)) for i in range(9)]
    trials = spark.createDataFrame([(t, "c", v, y, year, None, True, False) for t, v, year, y, _ in made], "trial_id string, crop string, variety_norm string, yield_kg_ha double, year int, note int, eligible boolean, derived boolean")
    links = spark.createDataFrame([(t, s) for t, *_, at in made for s in at], "trial_id string, site_id long")
    report = {(r.crop, r.climate_class): r for r in T.backtest(trials, links, sites, 2026).collect()}

    distance = lambda a, b: 0.0 if (a < 55) == (b < 55) else round((0.5 / 4.5) ** 0.5, 4)
    errors, hits, covered = [], [], 0
    firsts = {}
    for i in range(60):
        firsts.setdefault((f"S{i % 30:02}", i < 55), []).append(i)
    for (held, _), own in firsts.items():
        near = sorted((distance(own[0], s), f"S{s % 30:02}", s) for s in range(60))[:50]
        weight = {s: min(1 / (1 + d) for d, m, _ in near if m == n) for _, n, s in near if n != held}
        seen, sums = {}, {}
        for _, v, year, y, at in made:
            for s in set(at) & set(own):
                seen.setdefault(v, []).append(y)
            if all(f"S{s % 30:02}" != held for s in at) and set(at) & set(weight):
                w = max(weight[s] for s in at if s in weight) * 0.5 ** ((2026 - year) / 8)
                sums.setdefault(v, []).append((w, w * y))
        predicted = {v: round(sum(b for _, b in p) / sum(a for a, _ in p), 1) for v, p in sums.items()}
        observed = {v: sum(y) / len(y) for v, y in seen.items()}
        errors += [abs(predicted[v] - y) for v, y in observed.items() if v in predicted]
        best = lambda d: set(sorted(d, key=lambda v: (-d[v], v))[:3])
        hits.append(len(best(observed) & best(predicted)) / len(best(observed)))
        covered += bool(predicted)
    for key in ((None, None), ("c", None), (None, "Csa")):
        r = report[key]
        assert (r.folds, r.error_pairs, r.coverage) == (len(firsts), len(errors), 1.0) and covered == len(firsts)
        assert r.median_abs_error == pytest.approx(median(errors), abs=0.06) and r.top3_overlap == pytest.approx(sum(hits) / len(hits), abs=6e-4)
    assert tables["near"][0].count() <= 2 * 50 and tables["environment-sums"][0].count() <= 2 * 5  # before: 50 for each of the 35 folds
    assert tables["left"][0].where("thin").count() > 0


def shuffles(df) -> int:  # noqa: ANN001
    """Exchanges by hash in a plan before it is run."""
    return df._jdf.queryExecution().sparkPlan().toString().count("Window [") + df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")


def test_only_hot_keys_are_dealt_by_stretches(spark):
    moments = spark.createDataFrame([(i, "hot" if i % 4 else "cold" if i % 8 else None, None if i % 9 == 0 else i * 86400 * 3) for i in range(60)], "moment_id long, key string, s long")
    known = spark.createDataFrame([(i, "hot" if i % 3 else "cold", i * 86400 * 7 - (i % 2) * 86400, i / 2) for i in range(40)], "row_id long, key string, s long, value double")
    moments, known = (t.select("*", F.timestamp_seconds("s").alias("ts")).drop("s") for t in (moments, known))
    all_known = [r for r in known.collect()]
    expected = {}
    for m in moments.collect():
        before = [(r.ts, r.row_id, r.value) for r in all_known if m.key and m.ts and r.key == m.key and r.ts < m.ts]
        expected[m.moment_id] = max(before) if before else None
    for hot_rows in (1, 50, 1000):  # all, one, none
        rows = L.last_before(moments, known, ["key"], "ts", "row_id", hot_rows=hot_rows)
        assert rows.columns == ["moment_id", "key", "ts", "last"] and rows.select("last.*").columns == known.columns
        assert {r.moment_id: r.last and (r.last.ts, r.last.row_id, r.last.value) for r in rows.collect()} == expected
    assert shuffles(rows) == 1  # no key is hot: one window by key, nothing is grouped or carried (before: two windows and two groupings)


def test_only_records_at_near_sites_are_read_on(spark, monkeypatch):
    tables = {}

    def kept(df, name):  # noqa: ANN001, ANN202
        tables.setdefault(name, []).append(df)
        return written(df, name)

    monkeypatch.setattr(N, "written", kept)
    near = spark.createDataFrame([(1, 5, 0.5), (1, 6, 1.0)], "target_id long, site_id long, distance double")
    asked = spark.createDataFrame([(1, "oats")], "target_id long, crop string")
    rows = [(f"t{i}", "oats", "A", 1000.0 + i, 2026, {"rust": float(i)}) for i in range(50)]
    trials = spark.createDataFrame(rows, "trial_id string, crop string, variety_norm string, yield_kg_ha double, year int, scores map<string,double>")
    links = spark.createDataFrame([(f"t{i}", s) for i in range(50) for s in (i, i + 20)], "trial_id string, site_id long")
    (found,) = N.rank_for_targets(asked, near, trials, links, 2026).collect()
    assert (found.trial_count, found.scores, found.mean_yield) == (2, {"rust": 6.0}, round((1005 / 1.5 + 1006 / 2) / (1 / 1.5 + 1 / 2), 1))
    assert tables["records"][0].count() == 2 and tables["trial-groups"][0].count() == 2


def test_parcels_of_one_question_are_searched_once(spark, monkeypatch):
    tables = {}

    def kept(df, name):  # noqa: ANN001, ANN202
        tables.setdefault(name, []).append(written(df, name))
        return tables[name][-1]

    monkeypatch.setattr(R, "written", kept)
    figures = spark.createDataFrame([("A", c, 10.0 + i, 1.0, 0.0, 5.0, 4.0, 3.0) for i, c in enumerate(("corn", "oats", "rape", "rye"))], "zone string, crop string, " + ", ".join(f"{x} double" for x in R.DIMENSIONS) + ", n_requirement double")
    parcels = spark.createDataFrame([(i, "A", "rye" if i % 2 else None, 0.0 if i % 3 else None) for i in range(300)], "parcel_id long, zone string, previous string, cover_n double")
    locked = spark.createDataFrame([(i, y, "corn") for i in range(0, 300, 2) for y in (3, 3, 9)], "parcel_id long, year_no int, crop string")
    none = spark.createDataFrame([], "previous string, crop string"), spark.createDataFrame([], "year_no int, " + ", ".join(f"{x} double" for x in R.DIMENSIONS))
    rows = {r.parcel_id: (r.crops, r.score) for r in R.best_rotations(parcels, figures, *none, locked, years=4, beam=50, gap=2).collect()}
    assert len(rows) == 300 and len({(tuple(c), s) for c, s in rows.values()}) == 2
    assert all(c[2] == "corn" and c[3] not in c[1:3] for i, (c, _) in rows.items() if i % 2 == 0)
    assert all(c[0] != "rye" and len(set(c[:3])) == len(set(c[1:])) == 3 for i, (c, _) in rows.items() if i % 2)
    assert max(t.count() for t in tables["plans"]) <= 2 * 24  # before: those of 300 parcels


def test_records_meet_their_zones_once(spark):
    zones = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, None)], "site_id long, zone string")
    links = spark.createDataFrame([("t", 1), ("t", 2), ("t", 3), ("u", 3), ("v", 9), ("w", 4)], "trial_id string, site_id long").repartition("trial_id").distinct()
    records = spark.createDataFrame([("t", 1.0), ("t", 1.0), ("t", None), ("u", 5.0), ("v", 5.0), ("w", 7.0)], "trial_id string, y double")
    rows = V.in_zones(records, links, zones)
    assert Counter(tuple(r) for r in rows.collect()) == Counter([("t", y, z) for y in (1.0, None) for z in "AB"] + [("u", 5.0, "B"), ("w", 7.0, None)])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.index("Initial Plan") :].count("Exchange hashpartitioning") == 2 if "Initial Plan" in plan else plan.count("Exchange hashpartitioning") == 2


def test_zones_figures_are_from_one_scan_of_links(spark, sf, monkeypatch):
    from harrow.plans import field_queries

    tables = {}
    monkeypatch.setattr(R, "written", lambda df, name: tables.setdefault(name, df) and written(df, name))
    field_queries.rotation_greedy(spark, sf)
    plan = tables["zone-figures"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("Union") == 0  # before: links from two scans, united


def test_varieties_of_zones_are_summed_where_records_lie(spark, monkeypatch):
    tables = {}

    def kept(df, name):  # noqa: ANN001, ANN202
        tables.setdefault(name, []).append(df)
        return written(df, name)

    monkeypatch.setattr(N, "written", kept)
    monkeypatch.setattr(Q, "written", kept)
    zone = lambda s: None if s == 0 else "AB"[s % 2]
    sites = spark.createDataFrame([(s, zone(s)) for s in range(60)], "site_id long, climate_class string")
    made = [(f"t{i}", "oats", f"V{i % 7}", 2010 + i % 20, None if i % 11 == 0 else 1000.0 + 13 * i, 1.0, (i % 60, (i * 7 + i % 2) % 60)) for i in range(400)]
    made += [("t5", "oats", "V5", 2015, 1065.0, 1.0, (5,)), ("t5", "oats", "V5", 2015, 1065.0, 2.0, (5,)), ("x", None, "V0", 2026, 9e9, 1.0, (1,)), ("y", "rye", "V0", 2026, 9e9, 1.0, (1,)), ("z", "pea", "none", 2026, None, 1.0, (2,))]
    trials = spark.createDataFrame([(t, c, v, y, kg, {"rust": r}) for t, c, v, y, kg, r, _ in made], "trial_id string, crop string, variety_norm string, year int, yield_kg_ha double, scores map<string,double>")
    links = spark.createDataFrame([(t, s) for t, *_, at in made for s in at], "trial_id string, site_id long")
    crops = spark.createDataFrame([("oats",), ("oats",), ("pea",)], "crop string")
    sums, at = {}, {}
    for t, *_, places in made:
        at.setdefault(t, set()).update(z for z in map(zone, places) if z)
    for t, c, v, y, kg, _ in {m[:6] for m in made}:
        for z in at[t]:
            w = 0.5 ** (max(0, 2026 - y) / 8)
            s = sums.setdefault((z, c, v), [0.0, 0.0])
            s[0], s[1] = s[0] + w * (kg or 0.0), s[1] + w * (kg is not None)
    got = {(r.climate_class, r.crop): [(x.rank, x.variety, x.mean_yield) for x in r.varieties] for r in Q.zone_varieties(sites, trials, links, crops, 2026).collect()}
    assert got.keys() == {("A", "oats"), ("B", "oats")}
    for (z, c), best in got.items():
        means = sorted((-round(round(a / b, 6), 1), v) for (zz, cc, v), (a, b) in sums.items() if (zz, cc) == (z, c) and b)
        assert best == [(n, v, -m) for n, (m, v) in enumerate(means[:5], 1)]
    assert sum(t.count() for ts in tables.values() for t in ts) <= 2 * 9  # before: every record and its sites were written, and sums of each set of sites
