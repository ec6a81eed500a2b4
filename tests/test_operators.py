"""Golden cases of the operators, streams, rules and readers."""

from __future__ import annotations

import json

import pytest

from pyspark.sql import functions as F

from harrow.functions import agronomy as A
from harrow.operators import hygiene as H
from harrow.operators import rules as R
from harrow.operators import varieties as V
from harrow.plans.backtest import exact_median, nearest_by_features
from harrow.plans.queries import TARGET
from harrow.sources import bundles as B
from harrow.streaming import advisories as S

TRIAL = "trial_id string, crop string, variety string, variety_norm string, year int, yield_kg_ha double, note int, regime string, production string, derived boolean, eligible boolean, source_id string, confidence string, site_id long, second_site_id long"
SITE = "site_id long, name string, municipality string, climate_class string, soil_type string, rainfall int, et0 int, frost_days int, elevation int"


def domain(spark, trials, links, sites):
    rows = [(i, "WHEAT", v, v.upper(), 2026, y, n, None, "organic", False, None, "s", "high", None, None) for i, v, y, n in trials]
    return (
        spark.createDataFrame(rows, TRIAL),
        spark.createDataFrame(links, "trial_id string, site_id long"),
        spark.createDataFrame([(i, n, n, "EUROPE", None, 700, 1000, 30, 500) for i, n in sites], SITE),
    )


def ranked(spark, trials, links, sites, **options):
    rows = V.extrapolate(*domain(spark, trials, links, sites), "WHEAT", TARGET, 2026, **options).collect()
    return {r.variety: (r.mean_yield, r.numeric_yield_count, r.trial_count) for r in rows}


def test_trial_with_two_sites_of_one_name_counts_once(spark):
    got = ranked(spark, [("a", "v", 7300.0, None), ("b", "v", 4100.0, None)], [("a", 1), ("a", 2), ("b", 1)], [(1, "Twin Hill"), (2, "Twin Hill")])
    assert got == {"V": (5700.0, 2, 2)}


def test_trial_with_a_note_alone_never_enters_the_mean(spark):
    got = ranked(spark, [("a", "v", 6400.0, None), ("b", "v", 5200.0, None), ("c", "v", None, 4)], [("a", 1), ("b", 1), ("c", 1)], [(1, "S")])
    assert got == {"V": (5800.0, 2, 3)}


def test_held_out_site_removes_every_trial_seen_there(spark):
    trials = [("a", "v", 8800.0, None), ("b", "v", 5600.0, None), ("c", "v", 2400.0, None)]
    links = [("a", 1), ("b", 2), ("c", 1), ("c", 2)]
    assert ranked(spark, trials, links, [(1, "A"), (2, "B")])["V"][0] == 5600.0
    assert ranked(spark, trials, links, [(1, "A"), (2, "B")], exclude_sites=["A"])["V"] == (5600.0, 1, 1)


def test_upsert_twice_changes_nothing_more(spark):
    ddl = "k int, a string, b array<string>"
    old = spark.createDataFrame([(1, "x", ["p"]), (2, None, None)], ddl)
    new = spark.createDataFrame([(1, None, ["q", "p"]), (2, "n", ["z"]), (3, "m", None)], ddl)
    policy = {"a": "prefer_new", "b": "append"}
    once = H.upsert(old, new, ["k"], policy)
    twice = H.upsert(once, new, ["k"], policy)
    expected = [(1, "x", ["p", "q"]), (2, "n", ["z"]), (3, "m", None)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == expected


def test_sites_of_a_name_merge_when_close_and_split_when_far(spark):
    sites = spark.createDataFrame(
        [(1, "Vila (North)", 40.0, -3.0, 5.0), (2, "vila", 40.01, -3.0, None), (3, "VILA ", None, None, 1.0), (4, "Alto", 10.0, 10.0, None), (5, "alto", 20.0, 10.0, None), (6, "Solo", None, None, None)],
        "site_id long, name string, latitude double, longitude double, ph double",
    )
    got = {r.site_id: (r.canonical_key, r.survivor_id) for r in H.canonical_sites(sites, 15.0).collect()}
    assert {got[i][1] for i in (1, 2, 3)} == {1} and len({got[i][0] for i in (1, 2, 3)}) == 1
    assert got[4][0] != got[5][0] and got[4][0].startswith("alto#") and got[6] == ("solo", 6)


def test_conditions_fail_safe(spark):
    row = spark.createDataFrame([(5.0, None)], "value double, stage string")
    held = lambda *clauses: row.select(R.condition({"all": list(clauses)}, dict(row.dtypes)).alias("x")).first().x
    clause = lambda field, op, value: {"field": field, "op": op, "value": value}
    assert held() and held(clause("value", "gte", 5)) and held(clause("value", "in", [1.0, 5.0]))
    assert not held(clause("stage", "nin", ["a"])) and not held(clause("none", "nin", ["a"])) and not held(clause("value", "gt", "x")) and not held(clause("value", "odd", 1))


@pytest.mark.parametrize(
    ("clause", "held"),
    [
        ({"field": "value", "op": "gt", "value": [1]}, False),
        ({"field": "value", "op": "eq", "value": True}, False),
        ({"field": "on", "op": "eq", "value": True}, True),
        ({"field": "on", "op": "eq", "value": 1}, False),
        ({"op": "eq", "value": 1}, False),
        ({"field": "value", "op": "in", "value": 5}, False),
        ({"field": "value", "op": "in", "value": ["5", True, 5]}, True),
        ({"field": "value", "op": "nin", "value": ["5"]}, True),
        ({"field": "value", "op": "nin", "value": None}, False),
        ({"field": "name", "op": "in", "value": "a long name"}, True),
        ({"field": "name", "op": "nin", "value": "a long name"}, False),
        ({"field": "name", "op": "lt", "value": "zz"}, True),
        ({"field": "none", "op": "nin", "value": ["a"]}, False),
        ({"field": "list", "op": "eq", "value": [1]}, False),
    ],
)
def test_clauses_never_raise(spark, clause, held):
    row = spark.createDataFrame([(5.0, True, "long", None, [1])], "value double, on boolean, name string, none string, list array<int>")
    assert row.select(R.condition({"all": [clause]}, dict(row.dtypes)).alias("x")).first().x is held


def test_rules_that_are_absent_or_inactive_give_no_rows(spark):
    row = spark.createDataFrame([(5.0,)], "value double")
    for rules in ([], [{"id": "a", "active": False}], [{"id": "b", "species_links": ["wheat"]}]):
        matched = R.match_rules(row, rules)
        assert matched.columns == ["value", "rule_id", "priority", "urgency", "template"] and matched.count() == 0
    assert R.match_rules(row, [{"id": "c"}]).first().rule_id == "c"


def test_grid_of_features_finds_the_nearest_sites(spark):
    rows = [(i, f"s{i % 37}", "X" if i % 3 else None, None if i % 11 == 0 else (i * 37) % 900, 600 + (i * 53) % 800, (i * 7) % 90, (i * 131) % 1800) for i in range(150)]
    sites = spark.createDataFrame(rows, "site_id long, name string, climate_class string, rainfall int, et0 int, frost_days int, elevation int")
    whole = {(r.fold_id, r.site_id, r.distance) for r in nearest_by_features(sites, 5, cell_rows=1_000).collect()}
    for cell_rows in (1, 4):
        assert {(r.fold_id, r.site_id, r.distance) for r in nearest_by_features(sites, 5, cell_rows=cell_rows).collect()} == whole
    assert len(whole) == 5 * sum(r[3] is not None for r in rows)


def test_exact_median_equals_the_sorted_middle(spark):
    values = [("a", float(v)) for v in (5, 1, 1, 9)] + [("b", 2.5), ("b", None), ("b", 2.25), ("b", 2.75), (None, 7.0), ("c", None)]
    got = {r.k: r.median for r in exact_median(spark.createDataFrame(values, "k string, x double"), ["k"], "x", 2).collect()}
    assert got == {"a": 3.0, "b": 2.5, None: 7.0}


def test_stream_gives_the_changes_of_the_batch_and_replays_safely(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = [("t", "CropStatus", p, st, f"2024-01-{d:02d}T00:00:00Z", 60.0, "wheat") for d, (p, st) in enumerate([(1, "a"), (1, "a"), (2, "a"), (1, "b"), (2, None), (2, "a"), (1, "a")], 1)]
    names = ["tenant", "type", "parcel_id", "stage", "ts", "value", "species"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows) + "\nnot json\n")
    rules = [{"id": "r", "conditions": {"all": [{"field": "value", "op": "gte", "value": 50.0}]}, "action": {"description_template": "at {stage}"}}]
    for _ in range(2):
        assert S.run_advisories(spark, source, sink, checkpoint, rules, "t").awaitTermination(120)
    found = {r.advisory_id: r.description for r in S.latest_advisories(spark, sink).collect()}
    assert found == {f"advisory:t:{p}:r:{s}": f"at {s}" for p, s in ((1, "a"), (1, "b"), (2, "a"))}


def test_bundle_reader(spark, tmp_path):
    nodes = [{"@type": "VarietyTrial", "variety": "V", "year": 2020, "yield_kg_ha": "5000", "crop_eppo": "eppo:TRZAX"}, {"@type": "VarietyTrial", "skip_ingestion": True}, {"@type": "TrialSite", "name": "S"}, {"@type": "HarvestData"}]
    (tmp_path / "b.jsonld").write_text(json.dumps({"@context": {}, "@graph": nodes}))
    kinds = B.by_type(B.read_bundle(spark, str(tmp_path / "b.jsonld")))
    assert {k: df.count() for k, df in kinds.items()} == {"VarietyTrial": 1, "TrialSite": 1, "ManagementTrial": 0, "ArticleSource": 0}
    trial = B.trials_of(kinds["VarietyTrial"], source_id="src").first()
    assert (trial.year, trial.yield_kg_ha, trial.source_id) == (2020, 5000.0, "src")
    (tmp_path / "bad.jsonld").write_text("{}")
    with pytest.raises(Exception, match="no @graph"):
        B.read_bundle(spark, str(tmp_path / "bad.jsonld")).collect()


def test_keys_must_be_unique(spark):
    assert B.assert_unique(spark.createDataFrame([(1,), (2,)], "k int"), ["k"]).count() == 2
    with pytest.raises(Exception, match="not unique"):
        B.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()


def test_places_of_a_name_cluster_as_in_plain_python(spark):
    import random
    from math import asin, cos, radians, sin, sqrt

    pick = random.Random(4)
    spots = [(None, None), *((round(pick.uniform(0, 1), 2), round(pick.uniform(0, 1), 2)) for _ in range(25))]
    rows = [(i, pick.choice(["a", "b", "c"]), *pick.choice(spots), pick.choice([None, 1.0])) for i in range(300)]

    def km(a, b):
        x = sin(radians(a[0] - b[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(a[1] - b[1]) / 2) ** 2
        return 2 * 6371.0 * asin(sqrt(x))

    clusters, place = {}, {}
    for i, name, lat, lon, _ in rows:
        centers = clusters.setdefault(name, [])
        if lat is None:
            if not centers:
                centers.append(None)
            place[i] = (name, 0)
            continue
        near = next((n for n, c in enumerate(centers) if c is None or km(c, (lat, lon)) <= 30.0), len(centers))
        if near == len(centers):
            centers.append((lat, lon))
        elif centers[near] is None:
            centers[near] = (lat, lon)
        place[i] = (name, near)
    sites = spark.createDataFrame(rows, "site_id long, name string, latitude double, longitude double, ph double").repartition(3)
    got = {r.site_id: r.canonical_key for r in H.canonical_sites(sites, 30.0).collect()}
    assert len(got) == len(rows) and len(set(place.values())) == len(set(got.values())) > 3
    assert len({(place[i], got[i]) for i in place}) == len(set(got.values()))


def test_reference_readers(spark, tmp_path):
    (tmp_path / "f.csv").write_text("eppo_code,crude_protein_pct,organic_matter_digestibility_pct\nMEDSA,18.5,x\nTRFPR,,70\n")
    assert [tuple(r) for r in B.read_reference(spark, str(tmp_path / "f.csv"), "feeds").collect()] == [("MEDSA", 18.5, None), ("TRFPR", None, 70.0)]
    (tmp_path / "g.csv").write_text("ScientificName,CycleLow,CycleHigh,LifeForm,Family\nVicia faba,90,220,herb,Fabaceae\n")
    assert B.read_reference(spark, str(tmp_path / "g.csv"), "growing_cycles").first().asDict()["cycle_max"] == 220
    (tmp_path / "o.json").write_text(json.dumps([{"species_eppo": "VICFX", "yield_kg_ha": 2100, "other": 1}, {"variety": "v"}]))
    assert [(r.species_eppo, r.yield_kg_ha, r.variety) for r in B.read_observations(spark, str(tmp_path / "o.json")).collect()] == [("VICFX", 2100.0, None), (None, None, "v")]


def test_yaml_seed(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("species:\n- name: wheat\n  kc: 1.1\n- name: oat\n")
    assert [tuple(r) for r in B.read_yaml_seed(spark, str(tmp_path / "s.yaml"), "species", "name string, kc double").collect()] == [("wheat", 1.1), ("oat", None)]
    with pytest.raises(ValueError, match="at most"):
        B.read_yaml_seed(spark, str(tmp_path / "s.yaml"), "species", "name string", max_bytes=3)


def test_capabilities_are_exploded(spark):
    ddl = "moduleId string, version string, publishes array<struct<entityType:string,attributes:array<struct<name:string,unitCode:string,sources:array<string>>>>>"
    rows = [("m", "1", [("Soil", [("ph", None, ["a"]), ("oc", "P1", None)]), ("Empty", [])]), ("n", "2", None)]
    got = B.capabilities(spark.createDataFrame(rows, ddl)).collect()
    assert [(r.module_id, r.entity_type, r.attribute, r.unit, r.sources) for r in got] == [("m", "Soil", "ph", None, ["a"]), ("m", "Soil", "oc", "P1", None)]


def test_notifications_are_enriched(spark):
    rows = spark.createDataFrame([(1, "flowering"), (2, "sown")], "parcel_id long, stage string")
    crops = spark.createDataFrame([(1, "cover_crop", "active", "mowing", "2026-10-20")], "parcel_id long, role string, status string, termination_method string, sowing_start string")
    got = {r.parcel_id: (r.role, r.days_until_sowing) for r in S.enriched(rows, crops, "2026-10-15").collect()}
    assert got == {1: ("cover_crop", 5), 2: (None, None)}


def test_content_keys_drainage_and_nodata(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0), (1, "a", 2.0)], "k int, a string, b double")
    keys = [r.merge_key for r in H.content_key(rows, F.col("k").cast("string"), ["b", "a"]).collect()]
    assert keys[0] == keys[2] != keys[1] and all(len(k) == 14 and k.startswith("1|") for k in keys)
    wet = spark.createDataFrame([(" b", None), (None, 1.0), (None, None), ("D", 99.0)], "g string, k double")
    assert [r.d for r in wet.select(A.drainage_class(F.col("g"), F.col("k")).alias("d")).collect()] == ["well_drained", "moderate", None, "poor"]
    soil = spark.createDataFrame([(-9999.0,), (6.5,), (15.0,), (None,)], "ph double")
    assert [r.v for r in soil.select(A.nodata(F.col("ph"), 0.0, 14.0).alias("v")).collect()] == [None, 6.5, None, None]
    assert sum(part.count() for part in H.in_batches(rows.withColumn("n", F.monotonically_increasing_id()), 2)) == 3


def test_site_keys_fold_letters_of_all_latin_alphabets(spark):
    names = ["Kraków  Żółty (PL)", "Győr", "Žďár nad Sázavou", "Århus Ø", "İzmir", "São  João", None, "", "Plain (a) (b)"]
    got = [r.k for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", A.site_key(F.col("n")).alias("k")).orderBy("i").collect()]
    assert got[:4] == ["krakow zolty", "gyor", "zdar nad sazavou", "arhus o"] and got[5:] == ["sao joao", "", "", "plain (a)"]
