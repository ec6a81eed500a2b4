"""Suggested crops and rotations on tables of a few rows, against plain Python, with missing values, ties and repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import suggestions as S

PARCEL = "parcel_id int, rainfall double, et0 double, frost double, elevation double, climate_class string, season string, management string, area_ha double, ph double, texture string, awc_mm double"
CROP = "crop string, slots array<string>, season_days int, ph_min double, ph_max double, textures array<string>, frost_damage_c double"
ROTATED = "parcel_id int, starting_crop string, years int, organic_matter_pct string"


def suggested(spark, parcels, crops):
    sites = spark.createDataFrame(
        [(i, f"site{i}", "Csa", 400.0 + i, 1000.0, 10.0, 300.0 + i) for i in (1, 2, 3)], "site_id int, name string, climate_class string, rainfall double, et0 double, frost_days double, elevation double"
    )
    rows = [("a", "oat", "X", 4000.0), ("b", "pea", "Y", 2000.0), ("c", "rye", "Z", None), ("d", "oat", "W", 4000.0), ("e", "bean", "V", 4000.0)]
    trials = spark.createDataFrame(rows, "trial_id string, crop string, variety_norm string, yield_kg_ha double")
    trials = trials.withColumns({"year": F.lit(2026), "scores": F.create_map(F.lit("note"), F.lit(None).cast("double"))})
    links = trials.select("trial_id", F.lit(1).alias("site_id"))
    out = S.suggest_crops(spark.createDataFrame(parcels, PARCEL), spark.createDataFrame(crops, CROP), trials, links, sites, 2026, price_per_t=200.0, seed_price=100.0, operation_cost=20.0)
    return {(r.parcel_id, r.crop): r for r in out.collect()}


def test_crops_are_scored_against_the_best_of_the_parcel(spark):
    here = (400.0, 1000.0, 10.0, 300.0, "Csa")
    parcels = [
        (1, *here, None, "organic", 2.0, 6.0, "Sandy loam", 100.0), (2, *here, "winter", None, None, None, None, None), (3, *here, "autumn", "any", 0.0, 9.0, "clay", 0.0),
        (4, None, None, None, None, None, None, None, None, None, None, None),
    ]
    crops = [
        ("oat", ["winter"], 100, 5.0, 7.0, ["LOAM"], -3.0), ("pea", ["winter", "spring"], 365, 6.5, None, ["clay"], -8.0), ("rye", ["winter"], 100, None, None, None, None),
        ("bean", None, None, None, None, None, None),
    ]
    got = suggested(spark, parcels, crops)
    # a season that no crop has, and an environment that is not known at all, have no crops; rye has no yield
    assert sorted(got) == [(1, "bean"), (1, "oat"), (1, "pea"), (2, "oat"), (2, "pea")]
    oat, pea, bean = got[1, "oat"], got[1, "pea"], got[1, "bean"]
    assert (oat.variety, oat.yield_kg_ha, oat.margin_eur_ha, oat.parcel_margin_eur) == ("W", 4000.0, 600.0, 1200.0)
    assert (oat.organic_yield_kg_ha, oat.organic_margin_eur_ha) == (3200.0, 440.0)
    assert (oat.soil, oat.score, oat.rank, oat.frost_risk) == ("suitable", 100.0, 1, True)
    assert (pea.soil, list(pea.soil_problems), pea.frost_risk) == ("warning", ["ph", "texture"], False)
    assert pea.score == round(2000 / 4000 * 40 + 200 / 600 * 30 + 20 + 5, 1)
    assert (bean.soil, bean.score) == ("unknown", 90.0)
    assert (pea.water_deficit_mm, pea.water_ratio, pea.water_demand) == (720.0, 7.2, "high") and oat.water_demand == "low"
    assert list(got[2, "oat"].gaps) == ["few_trials", "no_soil"] and got[2, "oat"].organic_yield_kg_ha is None and got[2, "oat"].parcel_margin_eur is None


def test_no_parcels_and_no_crops(spark):
    assert suggested(spark, [], [("oat", ["winter"], 100, None, None, None, None)]) == {}
    assert suggested(spark, [(1, 400.0, 1000.0, 10.0, 300.0, "Csa", None, None, None, None, None, None)], []) == {}


FIGURES = {"oat": (3000.0, 2.0, 0.0, 80.0, 4), "pea": (2000.0, 1.0, 90.0, 20.0, None), "rye": (None, None, None, None, 2)}
NEXT = {"oat": ["pea", "rye"], "none": ["rye", "oat", "pea"], "pea": []}
REASONS, PESTS = {("rye", "oat"): "a", ("pea", "pea"): "b"}, {("oat", "rye"): (3, "medium")}


def expected(start, years, matter):
    """The rotation in plain Python: rows, total margin and the nitrogen left."""
    pool = ([start] if start else []) + NEXT.get(start or "none", [])
    held, rows, margin = (round(float(matter) * 15, 1) if matter is not None else 50.0), [], 0.0
    for i in range(years):
        crop = pool[i % len(pool)]
        y, _, fixed, required, operations = (v or 0.0 for v in FIGURES.get(crop, (None,) * 5))
        balance = fixed - required + (held if i else 0)
        held = max(0.0, held + fixed - required)
        before = pool[(i - 1) % len(pool)]
        n, risk = PESTS.get((before, crop)) or PESTS.get((crop, before)) or (0, "none")
        margin += y * 2 - (1 + (operations or 5) * 3)
        rows.append((i + 1, crop, y, balance, held, REASONS.get((before, crop)) if i else None, n if i else 0, risk if i else "none"))
    return rows, margin, held


def test_rotations_equal_plain_python(spark):
    parcels = [(1, "oat", 6, "2"), (2, None, 5, None), (3, "pea", 3, "0"), (4, "strange", 2, "x"), (5, "oat", 1, None), (6, "oat", 7, None), (7, "oat", None, None), (8, "oat", 6, "2"), (8, "oat", 6, "2")]
    follow = [(p, c, i) for p, crops in NEXT.items() for i, c in enumerate(crops)]
    crops = [(c, c.upper(), y, k, f, r, o) for c, (y, k, f, r, o) in FIGURES.items()]
    plans = S.rotation_plans(
        spark.createDataFrame(parcels, ROTATED), spark.createDataFrame(follow, "previous string, crop string, place int"),
        spark.createDataFrame(crops, "crop string, variety string, yield_kg_ha double, carbon double, fixed_n double, required_n double, operations int"),
        spark.createDataFrame([(a, b, r) for (a, b), r in REASONS.items()] + [("rye", "oat", "z")], "crop_a string, crop_b string, reason string"),
        spark.createDataFrame([(a, b, n, r) for (a, b), (n, r) in PESTS.items()], "crop_a string, crop_b string, n long, risk string"), harvest_price=2.0, operation_cost=3.0,
    )
    got = plans.collect()
    assert len(got) == len(parcels)
    assert {r.parcel_id: r.status for r in got} == {1: "ok", 2: "ok", 3: "ok", 4: "ok", 5: "years", 6: "years", 7: "years", 8: "ok"}
    for r in got:
        _, start, years, matter = next(p for p in parcels if p[0] == r.parcel_id)
        if r.status != "ok":
            assert r.plan == [] and r.final_n is None and r.initial_n is None
            continue
        rows, margin, held = expected(start, years, matter if matter != "x" else None)
        assert [(p.year_no, p.crop, p.yield_kg_ha, p.n_balance, p.soil_n, p.reason, p.shared_pests, p.pest_risk) for p in r.plan] == rows
        assert (r.total_margin_eur_ha, r.final_n) == (margin, held)
    assert S.rotation_years(plans).count() == sum(len(r.plan) for r in got)


def test_a_pool_without_crops_has_no_plan(spark):
    none = spark.createDataFrame([], "previous string, crop string, place int")
    crops = spark.createDataFrame([], "crop string, variety string, yield_kg_ha double, carbon double, fixed_n double, required_n double, operations int")
    barred, pests = spark.createDataFrame([], "crop_a string, crop_b string, reason string"), spark.createDataFrame([], "crop_a string, crop_b string, n long, risk string")
    (row,) = S.rotation_plans(spark.createDataFrame([(1, None, 3, None)], ROTATED), none, crops, barred, pests).collect()
    assert (row.status, row.plan) == ("no_crops", [])


def test_soil_groups_and_the_better_climate(spark):
    around = spark.createDataFrame([(i, "Csa" if i < 4 else None) for i in range(1, 6)], "parcel_id int, climate_class string")
    soils = spark.createDataFrame([(1, "loam"), (1, "zz"), (2, "Loam"), (3, ""), (4, None)], "parcel_id int, texture string")
    sites = spark.createDataFrame([(7, "sandy loam", "Arenosol"), (3, "loamy", None), (9, "clay loam", "Vertisol"), (8, "Silt Loam", "Gleysol"), (1, None, "none")], "site_id int, soil_texture string, soil_type string")
    found = spark.createDataFrame([(1, "Dfb", 40, 500, 700), (4, None, 3, None, None)], "parcel_id int, climate_class string, frost_days int, rainfall int, et0 int")
    got = {r.parcel_id: r for r in S.soil_and_climate(around, soils, sites, found).collect()}
    assert [(got[i].climate_class, got[i].climate_source) for i in range(1, 6)] == [("Dfb", "reanalysis"), ("Csa", "nearby_site"), ("Csa", "nearby_site"), (None, "reanalysis"), (None, "unavailable")]
    # the smallest site whose texture holds it has no type, so the group isn't known
    assert [(got[i].soil_group, got[i].soil_source) for i in (1, 2, 3)] == [(None, "soil_survey"), ("Gleysol", "soil_survey"), (None, "unavailable")]
