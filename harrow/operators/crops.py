"""Crop catalogue, reference values, comparisons, and what is known of a parcel.

Catalogue tables (species, stages, tolerances) are reference data of some thousand rows; joins by part of a name run over
those alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import agronomy as A
from harrow.operators.hygiene import nearest_places
from harrow.operators.parts import holding

#: Whether a crop's grain holds gluten, by EPPO code (fixed values).
CONTAINS_GLUTEN = "TRZAX TRZDU TRZAW HORVX HORVW SECCE TTLSS".split()
GLUTEN_CAVEAT = ["AVESA"]
GLUTEN_FREE = (
    "ZEAXX ZEAMX SORVU ORYSA CIEAR PIBSX PISSA VICFX VICSA VICER LENCU LTHSA GLXMA LUPAL LUPAN PHVUX BRSNW BRSNN BRPNA HELAN SOLTU BETVU "
    "SOLLC SOLME CAPAN CPSAN CUMSA CUCUM ALLCE ALLPO LYPES CUMME FRAAN OLEU VITIS PRMDO PRNAR PRNDU MABSD CITRU PRMPE MEDSA MEDLU TRFPR"
).split()
#: Month of cover termination, degree days a spring day, and first sowing days by climate class (fixed values).
TERMINATION_MONTH = {"Csa": 5, "BSk": 6, "Cfb": 6, "BSh": 4, "Dfa": 6, "Dfb": 6}
SPRING_GDD_A_DAY = {"BSk": 8, "BSh": 12, "Csa": 10, "Cfb": 5, "Dfa": 10, "Dfb": 8}
COVER_START = {"Csa": "10-15", "BSk": "10-01", "Cfb": "09-15", "Dfa": "09-01", "Dfb": "08-15", "BSh": "10-15"}
PROTEIN_START = {"Csa": "04-01", "BSk": "04-15", "Cfb": "03-15", "Dfa": "04-15", "Dfb": "05-01", "BSh": "03-15"}
TYPICAL_COVER_GDD = 1200
REFERENCE = ("carbon_fixed_tco2e_ha", "operations_count", "n_requirement_kg_ha", "n_fixation_kg_ha", "growing_season_days")


def _known(df: DataFrame, key: str, **counts: Column) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*(c.alias(n) for n, c in counts.items()))


def species_list(species: DataFrame, params: DataFrame, common_names: dict[str, str]) -> DataFrame:
    """Species with a name to show and how many stages and parameter sets each has; ``params``: name, stage, param_id."""
    found = _known(params, "name", stage_count=F.count_distinct("stage"), params_count=F.count_distinct("param_id"))
    shown = F.element_at(A.lit_map(common_names), F.col("name")) if common_names else F.lit(None).cast("string")
    plain = F.concat(F.upper(F.substring("name", 1, 1)), F.lower(F.expr("substring(name, 2)")))
    count = lambda c: F.coalesce(c, F.lit(0))
    return species.join(found, "name", "left").select(
        "name", "scientific_name", F.coalesce(shown, plain).alias("common_name"), count("stage_count").alias("stage_count"),
        count("params_count").alias("params_count"), (count("params_count") > 0).alias("has_phenology"),
    )


def crop_catalog(crops: DataFrame, varieties: DataFrame, params: DataFrame, heat: DataFrame, search: str | None = None) -> DataFrame:
    """Crops (crop_id, name, scientific_name), optionally those with ``search`` in a name, with their numbers of varieties
    and whether parameters and tolerances are known. Children are counted before they are joined."""
    if search:
        part = F.lit(search.lower())
        crops = crops.where(F.lower("name").contains(part) | F.lower("scientific_name").contains(part))
    return (
        crops.join(_known(varieties, "crop_id", variety_count=F.count_distinct("variety_id")), "crop_id", "left")
        .join(_known(params, "crop_id", has_kc=F.lit(True)), "crop_id", "left")
        .join(_known(heat, "crop_id", has_thermal=F.lit(True)), "crop_id", "left")
        .select(
            "crop_id", "name", "scientific_name", F.coalesce("variety_count", F.lit(0)).alias("variety_count"),
            F.coalesce("has_kc", F.lit(False)).alias("has_kc"), F.coalesce("has_thermal", F.lit(False)).alias("has_thermal"),
        )
    )


def crop_detail(crops: DataFrame, varieties: DataFrame, params: DataFrame, heat: DataFrame, soil: DataFrame, nutrients: DataFrame) -> DataFrame:
    """Per crop: which data there are (a zero value counts as none), and its varieties' names in order."""
    some = lambda c: F.coalesce(F.bool_or(F.coalesce(F.col(c) != 0, F.lit(False))), F.lit(False))
    facts = (
        _known(varieties, "crop_id", varieties=F.sort_array(F.collect_set("name"))), _known(params, "crop_id", kc=some("kc"), d1_d2=some("d1"), mds=some("mds_ref")),
        _known(heat, "crop_id", thermal=F.lit(True)), _known(soil, "crop_id", soil_suitability=F.lit(True)), _known(nutrients, "crop_id", npk=F.lit(True)),
    )
    joined = reduce(lambda left, right: left.join(right, "crop_id", "left"), facts, crops)
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("kc", "d1_d2", "mds", "thermal", "soil_suitability", "npk")]
    return joined.select("crop_id", "name", *flags, F.coalesce("varieties", F.array().cast("array<string>")).alias("varieties"))


def coverage(species: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """One row: how many species there are, and how many have a child and have none."""
    have = children.select(key).where(F.col(key).isNotNull()).distinct().withColumn("has", F.lit(True))
    counted = species.join(have, key, "left").agg(F.count(F.lit(1)).alias("total"), F.count("has").alias("with"))
    return counted.select("total", "with", (F.col("total") - F.col("with")).alias("without"))


def data_gaps(asked: DataFrame, crops: DataFrame, params: DataFrame, heat: DataFrame, nutrients: DataFrame) -> DataFrame:
    """asked (a part of a name), gaps: the kinds of data that no crop with that part in a name has."""
    names = crops.select("crop_id", F.explode(F.array_compact(F.array(F.lower("name"), F.lower("scientific_name")))).alias("called"))
    sought = asked.withColumn("part", F.lower("asked"))
    fits = names.join(holding(names, "called", sought, "part"), "called").select("part", "crop_id").distinct()
    tables = (("has_params", params), ("has_thermal", heat), ("has_npk", nutrients))
    marked = reduce(lambda df, t: df.join(_known(t[1], "crop_id", **{t[0]: F.lit(True)}), "crop_id", "left"), tables, crops)
    found = sought.join(fits, "part", "left").join(marked, "crop_id", "left").groupBy("asked").agg(*(F.max(n).alias(n) for n, _ in tables))
    gap = lambda has, *names: F.when(F.col(has).isNull(), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    return found.select("asked", F.concat(gap("has_params", "d1", "d2", "mds"), gap("has_thermal", "thermal"), gap("has_npk", "npk")).alias("gaps"))


def crop_reference(crops: DataFrame, static: DataFrame, knowledge: DataFrame, taxonomy: DataFrame, cycles: DataFrame, default: dict[str, float]) -> DataFrame:
    """Reference values per EPPO code, each from the first layer that knows it, and where they come from.

    Nitrogen fixation: the mean of measured values; else for Fabaceae at least 60 with a requirement of 15, for Poaceae 0;
    else the static table or the default. Season: the middle of the growing cycle of the scientific name; else static.
    """
    measured = knowledge.where("parameter = 'n_fixation_kg_ha'").groupBy("eppo").agg(F.avg("value").alias("measured")).where("measured IS NOT NULL")
    base = crops.join(static, "eppo", "left").join(measured, "eppo", "left").join(taxonomy, "eppo", "left")
    low, high = F.nullif(F.col("cycle_min"), F.lit(0)), F.nullif(F.col("cycle_max"), F.lit(0))
    days = cycles.select(F.lower(F.trim("scientific_name")).alias("sci"), F.coalesce(F.expr("div(nullif(cycle_min, 0) + nullif(cycle_max, 0), 2)"), low, high).alias("days"))
    base = base.join(days, F.lower(F.trim("scientific_name")) == F.col("sci"), "left")
    value = {c: F.coalesce(F.col(c), F.lit(default[c])) for c in REFERENCE}
    family = F.lower(F.coalesce("family", F.lit("")))
    legume, grass = family.contains("fabaceae"), family.contains("poaceae")
    known = F.col("measured").isNotNull()
    fixation = F.when(known, F.round("measured", 1)).when(legume, F.greatest(value["n_fixation_kg_ha"], F.lit(60.0))).when(grass, 0.0).otherwise(value["n_fixation_kg_ha"])
    source = F.when(known, "measured").when(legume, "Fabaceae").when(grass, "Poaceae")
    return base.select(
        "eppo", value["carbon_fixed_tco2e_ha"].alias("carbon_fixed_tco2e_ha"), value["operations_count"].alias("operations_count"),
        F.when(~known & legume, 15.0).otherwise(value["n_requirement_kg_ha"]).cast("double").alias("n_requirement_kg_ha"), fixation.cast("double").alias("n_fixation_kg_ha"),
        F.coalesce("days", value["growing_season_days"]).cast("int").alias("growing_season_days"), source.alias("n_fixation_source"),
        F.when(F.col("days").isNotNull(), "growing cycle").alias("growing_season_source"),
    )


def gluten_status(eppo: Column) -> Column:
    code = F.upper(eppo)
    return (
        F.when(code.isin(CONTAINS_GLUTEN), "contains_gluten").when(code.isin(GLUTEN_CAVEAT), "gluten_free_caveat").when(code.isin(GLUTEN_FREE), "gluten_free")
        .otherwise("unknown")
    )


def grain_protein(yield_kg_ha: Column, crude_protein_pct: Column) -> Column:
    """kg of protein a hectare and its source: measured share of the grain (harvest index 0.45), else 12 % of the yield."""
    measured = crude_protein_pct > 0
    amount = F.when(measured, yield_kg_ha * 0.45 * crude_protein_pct / 100).otherwise(yield_kg_ha * 12.0 / 100)
    return F.struct(F.round(amount, 1).alias("protein_kg_ha"), F.when(measured, "variety_trials").otherwise("generic_12pct").alias("protein_source"))


def season_slots(slots: Column) -> Column:
    """Seasons a crop fits into; unknown means both."""
    return F.coalesce(slots, F.array(F.lit("summer"), F.lit("winter")))


def n_fixation_estimate(rows: DataFrame, organic_factor: float = 0.8) -> DataFrame:
    """``rows`` with the nitrogen of a cover crop, half of it available, what a legume cover fixes, and the protein that follows.

    Columns: cover_biomass_t_ha, n_content_pct, cover_type, n_fixation_kg_ha, protein_yield_kg_ha, harvest_index (0.35 if
    unknown), protein_content_pct (25), management. Zero amounts are null.
    """
    total = F.when(F.col("n_content_pct") > 0, F.col("cover_biomass_t_ha") * 1000 * (F.col("n_content_pct") / 100)).otherwise(0.0)
    positive = lambda c: F.when(c > 0, F.round(c, 1))
    fixed = F.when(F.col("cover_type") == "legume", F.col("n_fixation_kg_ha"))
    harvest = F.col("protein_yield_kg_ha") * F.when(F.col("management") == "organic", organic_factor).otherwise(1.0)
    protein = harvest * F.coalesce("harvest_index", F.lit(0.35)) * (F.coalesce("protein_content_pct", F.lit(25.0)) / 100)
    return rows.withColumns({
        "n_cover_total_kg_ha": positive(total), "n_cover_available_kg_ha": positive(total * 0.5),
        "n_protein_fixed_kg_ha": F.when(fixed != 0, F.round(fixed, 1)), "protein_kg_ha": F.bround(protein, 0),
    })


def sequence_dates(rows: DataFrame, year: int = 2026) -> DataFrame:
    """``rows`` (climate_class, cover_gdd, protein_gdd) with the dates of a cover crop and the protein crop after it.

    The cover ends in the middle of its class's month, moved by a day for each day of degree days that it needs more or
    less than usual; the protein crop follows ten days later, not before its window, and ripens at the spring rate.
    """
    of = lambda values, default: F.coalesce(F.element_at(A.lit_map(values), F.col("climate_class")), F.lit(default))
    rate = F.greatest(of(SPRING_GDD_A_DAY, 8), F.lit(3))
    day = lambda y, month_day: F.to_date(F.concat(F.lit(f"{y}-"), month_day))
    offset = ((F.col("cover_gdd") - TYPICAL_COVER_GDD) / rate).cast("int")
    ended = F.date_add(F.make_date(F.lit(year + 1), of(TERMINATION_MONTH, 5), F.lit(15)), offset)
    sown = F.greatest(F.date_add(ended, 10), day(year + 1, of(PROTEIN_START, PROTEIN_START["Csa"])))
    dates = {
        "cover_crop_sowing_date": day(year, of(COVER_START, COVER_START["Csa"])), "termination_date": ended, "protein_crop_sowing_date": sown,
        "protein_crop_harvest_date": F.date_add(sown, (F.col("protein_gdd") / rate).cast("int")),
    }
    return rows.withColumns({n: d.cast("string") for n, d in dates.items()} | {"gdd_per_day_spring": of(SPRING_GDD_A_DAY, 8)})


def compare_crops(offers: DataFrame, keys: list[str], seed_price: float = 1.0, harvest_price: float = 1.0, operation_cost: float = 1.0) -> DataFrame:
    """Crops of each parcel compared: margin, composite score, and places by margin, carbon and score.

    ``offers``: keys, crop, expected_yield_kg_ha (null: 0), operations_count, carbon_fixed_tco2e_ha, soil_ph, ph_min, ph_max.
    Score: 40 for the yield, 30 for the margin and 20 for the carbon, each relative to the best (if that is 0, to 1), and 10
    for a soil in range or without bounds, else 5. Ties in a ranking go to the crop that is first in the alphabet.
    """
    yields = F.round(F.coalesce("expected_yield_kg_ha", F.lit(0.0)), 1)
    cost = F.lit(seed_price) + F.col("operations_count") * F.lit(operation_cost)
    out = (F.nullif("ph_min", F.lit(0.0)).isNotNull() & F.nullif("ph_max", F.lit(0.0)).isNotNull() & (F.coalesce("soil_ph", F.lit(0.0)) != 0)
           & ~F.col("soil_ph").between(F.col("ph_min"), F.col("ph_max")))
    rows = offers.select(
        *keys, "crop", yields.alias("expected_yield_kg_ha"), F.round(cost, 2).alias("total_cost_eur_ha"),
        F.round(F.coalesce("expected_yield_kg_ha", F.lit(0.0)) * F.lit(harvest_price) - cost, 2).alias("net_margin_eur_ha"), "carbon_fixed_tco2e_ha",
        F.when(F.coalesce(out, F.lit(False)), "warning").otherwise("suitable").alias("soil"),
    )
    whole = Window.partitionBy(*keys)
    best = lambda c: F.coalesce(F.nullif(F.max(c).over(whole), F.lit(0.0)), F.lit(1.0))
    score = (
        40 * F.col("expected_yield_kg_ha") / best("expected_yield_kg_ha") + 30 * F.col("net_margin_eur_ha") / best("net_margin_eur_ha")
        + 20 * F.col("carbon_fixed_tco2e_ha") / best("carbon_fixed_tco2e_ha") + F.when(F.col("soil") == "suitable", 10).otherwise(5)
    )
    scored = rows.withColumn("composite_score", F.round(score, 1))
    place = lambda c: F.row_number().over(whole.orderBy(F.col(c).desc(), F.col("crop")))
    return scored.withColumns({
        "by_margin": place("net_margin_eur_ha"), "by_carbon": place("carbon_fixed_tco2e_ha"), "by_score": place("composite_score"),
    })


def scenarios(asked: DataFrame, constraints: DataFrame, soil: DataFrame, nutrients: DataFrame) -> DataFrame:
    """For each (baseline, scenario): rotation and soil verdicts, change of the nitrogen need, and a recommendation.

    A restriction with an interval breaks the rotation; a crop without soil data is no fit; needs that differ by more than
    1 are noted. ``nutrients``: crop, element, uptake.
    """
    rule = (
        constraints.where("effect IS NULL OR effect = 'restriction'").where("interval_years > 0")
        .groupBy(F.lower("crop_a").alias("a"), F.lower("crop_b").alias("b")).agg(F.min_by("reason", "interval_years").alias("reason"), F.min("interval_years").alias("years"))
    )
    fit = soil.select(F.lower("crop").alias("s"), F.lit(True).alias("soil_ok")).distinct()
    need = nutrients.where("element = 'nitrogen'").groupBy(F.lower("crop").alias("c")).agg(F.sum("uptake").alias("n"))
    rows = (
        asked.join(rule, (F.lower("baseline") == F.col("a")) & (F.lower("scenario") == F.col("b")), "left")
        .join(fit, F.lower("scenario") == F.col("s"), "left")
        .join(need.select(F.col("c").alias("c0"), F.col("n").alias("n0")), F.lower("baseline") == F.col("c0"), "left")
        .join(need.select(F.col("c").alias("c1"), F.col("n").alias("n1")), F.lower("scenario") == F.col("c1"), "left")
    )
    rotation_ok, soil_ok = F.col("years").isNull(), F.coalesce("soil_ok", F.lit(False))
    delta = F.coalesce("n1", F.lit(0.0)) - F.coalesce("n0", F.lit(0.0))
    issues = F.concat_ws(
        "; ", F.when(~rotation_ok, "rotation constraint violated"), F.when(~soil_ok, "soil suitability issues"), F.when(F.abs(delta) > 0, "fertilizer adjustment needed")
    )
    return rows.select(
        "baseline", "scenario", rotation_ok.alias("rotation_ok"),
        F.when(~rotation_ok, F.concat("reason", F.lit(". Minimum interval: "), F.col("years").cast("string"), F.lit(" years."))).otherwise("").alias("rotation_issue"),
        soil_ok.alias("soil_ok"), F.when(F.abs(delta) > 1, F.round(delta, 1)).alias("n_delta"),
        F.when(delta > 1, "Scenario needs more N than baseline").when(delta < -1, "Scenario needs less N than baseline").alias("note"),
        F.when(issues == "", F.concat("scenario", F.lit(" is a suitable alternative to "), "baseline", F.lit(".")))
        .otherwise(F.concat("scenario", F.lit(" vs "), "baseline", F.lit(": "), issues, F.lit(". Review before adopting."))).alias("recommendation"),
    )


def weekly_et0(points: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Sum of the known daily values from ``start`` to ``end``; null unless it is above zero."""
    inside = points.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    total = F.sum("et0")
    return inside.groupBy(*keys).agg(F.when(total > 0, F.round(total, 1)).alias("et0_mm"))


def assessment_fallback(asked: DataFrame, assessments: DataFrame, newest: int = 5) -> DataFrame:
    """Stage and parameters for questions (tenant, species) that no reference answers, from a tenant's newest assessments.

    Of the ``newest`` the latest one counts whose species holds the asked name, else the latest of all. Zero baselines count
    as missing and give way to their older names. Nothing is given if no parameter is known.
    """
    by_time = Window.partitionBy("tenant").orderBy(F.col("assessed_at").desc(), F.col("assessment_id"))
    recent = assessments.withColumn("age", F.row_number().over(by_time)).where(F.col("age") <= newest)
    met = asked.join(recent.withColumnRenamed("species", "assessed"), "tenant")
    holds = F.coalesce(F.lower("assessed").contains(F.lower("species")), F.lit(False))
    first = Window.partitionBy("tenant", "species").orderBy(F.when(holds, 0).otherwise(1), "age")
    some = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit(0.0)) for n in names))
    found = met.withColumn("n", F.row_number().over(first)).where("n = 1").select(
        "tenant", "species", "assessment_id", "stage", "kc", "ky", some("d1", "nwsb_baseline").alias("d1"), some("d2", "max_stress_baseline").alias("d2"), "mds_ref"
    )
    return found.where("kc IS NOT NULL OR d1 IS NOT NULL OR d2 IS NOT NULL OR mds_ref IS NOT NULL")


def forage_value(crops: DataFrame, feeds: DataFrame) -> DataFrame:
    """Crude protein and digestibility of crops that are feeds; feeds without either figure are left out."""
    code = feeds.select(F.upper(F.trim("eppo_code")).alias("code"), "crude_protein_pct", "organic_matter_digestibility_pct")
    known = code.where("crude_protein_pct IS NOT NULL OR organic_matter_digestibility_pct IS NOT NULL")
    return crops.join(known, F.upper("eppo") == F.col("code")).drop("code")


def organic_inputs(pests: DataFrame, inputs: DataFrame) -> DataFrame:
    """eppo, product, category: permitted products whose target list holds the name of one of the crop's pests."""
    named = pests.select("eppo", F.lower("pest").alias("pest")).where("pest <> ''").distinct()
    aimed = inputs.withColumn("targets", F.lower(F.coalesce("target_pests", F.lit(""))))
    return named.join(holding(aimed, "targets", named, "pest"), "pest").join(aimed, "targets").select("eppo", "product", "category").distinct()


def observation_series(products: DataFrame, key: str, columns: dict[str, str], most: int = 200) -> DataFrame:
    """Per parcel, for each of ``columns`` (name -> column): its observations by date, their number and the latest.

    At most ``most`` products of a parcel are read, the newest: that is the view's page.
    """
    newest = Window.partitionBy(key).orderBy(F.col("day").desc(), F.col("product_id"))
    page = products.where("day IS NOT NULL").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most)
    series = {n: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("day").cast("string").alias("day"), F.col("product_id"), F.col(c).alias("value"))))) for n, c in columns.items()}
    rows = page.groupBy(key).agg(*(s.alias(n) for n, s in series.items()))
    current = lambda n: F.get(n, F.size(n) - 1)["value"]
    return rows.select(key, *(c for n in columns for c in (F.transform(n, lambda x: x["value"]).alias(n), F.size(n).alias(f"{n}_count"), current(n).alias(f"{n}_current"))))


def parcel_environment(parcels: DataFrame, sites: DataFrame, max_km: float = 50.0) -> DataFrame:
    """parcel_id, lat, lon, area_ha, irrigation, irrigation_source, climate_class, site_km: a parcel's environment before a crop is assigned.

    The place is the first pair of a GeoJSON's coordinates, however deep. Irrigation: by the system's name, else by the
    regime's. Climate: the class of the nearest site within ``max_km``; sites are looked for in the neighbouring cells of a
    one-degree grid, wider towards the poles, once for each distinct place, so no parcel meets all of them.
    """
    pair = F.regexp_extract(F.coalesce("location", F.lit("")), r"\[\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)", 1), F.regexp_extract(F.coalesce("location", F.lit("")), r"\[\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)", 2)
    lon, lat = (p.try_cast("double") for p in pair)
    holds = lambda c, words: reduce(lambda a, b: a | b, (F.lower(c).contains(w) for w in words))
    system, regime = F.nullif(F.trim("irrigation_system"), F.lit("")), F.nullif(F.trim("irrigation_regime"), F.lit(""))
    watered = F.when(system.isNotNull(), holds(system, ("drip", "sprinkler", "flood", "pivot", "irrigat"))).when(regime.isNotNull(), holds(regime, ("regad", "irrig")))
    place = parcels.select(
        "parcel_id", lat.alias("lat"), lon.alias("lon"), F.col("area").try_cast("double").alias("area_ha"), F.when(watered, "irrigated").when(~watered, "rainfed").alias("irrigation"),
        F.when(system.isNotNull(), "system").when(regime.isNotNull(), "regime").otherwise("unknown").alias("irrigation_source"),
    )
    known = sites.where("climate_class IS NOT NULL").select("latitude", "longitude", "site_id", "climate_class")
    best = nearest_places(place.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")), known, max_km)
    best = best.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "site", F.col("km").alias("site_km"))
    nearest = F.min(F.when(F.col("site_km").isNotNull() & F.col("parcel_id").isNotNull(), F.struct("site_km", "site"))).over(Window.partitionBy("parcel_id"))
    rows = place.join(best, ["lat", "lon"], "left").select(*place.columns, nearest.alias("nearest"))
    return rows.select(*place.columns, "nearest.site.climate_class", "nearest.site_km")


def successors(pool: DataFrame, recommended: DataFrame) -> DataFrame:
    """Rows of ``pool`` (previous, eppo, name) whose name or code is a recommended successor's name, scientific name or code."""
    names = recommended.select("previous", F.explode(F.array_compact(F.array("name", "scientific_name", "eppo_code"))).alias("called"))
    names = names.select("previous", F.lower("called").alias("called")).where("called <> ''").distinct()
    offered = pool.withColumn("called", F.explode(F.array_distinct(F.array(F.lower(F.coalesce("name", "eppo")), F.lower("eppo")))))
    return offered.where("eppo <> previous").join(names, ["previous", "called"], "left_semi").drop("called").distinct()
