"""Crop, soil, water and rotation decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import agronomy as A


def phenology_cascade(asked: DataFrame, stages: DataFrame, params: DataFrame) -> DataFrame:
    """For each question (query_id, species, stage?, gdd?, cultivar?, management?) the stage and its best parameters.

    Stage: by name, else the one whose half-open degree-day range holds gdd, else the first that has parameters.
    Parameters: exact cultivar and management, then management alone, then the default, then any other; of several of a
    kind the one with the smallest kc. Questions of unknown species keep a row of nulls.

    A species' stages are one array, and parameters are reduced to the best of each kind before a question meets them, so
    each question stays one row and no window is needed.
    """
    has = stages.join(params.select("species", "stage").distinct(), ["species", "stage"], "left_semi")
    of_species = has.groupBy("species").agg(F.collect_list(F.struct("stage", "gdd_min", "gdd_max")).alias("stages"))
    asked = asked.select("query_id", "species", F.lower("stage").alias("named"), "gdd", "cultivar", "management")
    staged = asked.join(of_species, "species", "left")
    held = lambda s: (F.col("gdd") >= s["gdd_min"]) & (F.col("gdd") < s["gdd_max"])
    rank = lambda s: F.when(F.col("named") == F.lower(s["stage"]), 0).when(held(s), 1).otherwise(2)
    order = F.transform("stages", lambda s: F.struct(rank(s).alias("rank"), s["gdd_min"].isNull().alias("open"), s["gdd_min"].alias("gdd_min"), s["stage"].alias("stage")))
    chosen = staged.select("query_id", "species", "cultivar", "management", F.array_min(order)["stage"].alias("stage"))
    kc = F.struct(F.lit(True).alias("known"), F.min("kc").alias("kc"))
    stage = ["species", "stage"]
    exact = params.where("cultivar IS NOT NULL AND management IS NOT NULL").groupBy(*stage, "cultivar", "management").agg(kc.alias("exact"))
    managed = params.where("cultivar IS NULL AND management IS NOT NULL").groupBy(*stage, "management").agg(kc.alias("managed"))
    usual = params.where("is_default").groupBy(*stage).agg(kc.alias("usual"))
    other = params.groupBy(*stage).agg(kc.alias("other"))
    met = chosen.join(exact, [*stage, "cultivar", "management"], "left").join(managed, [*stage, "management"], "left").join(usual, stage, "left").join(other, stage, "left")
    priority = F.when(F.col("exact.known"), 0).when(F.col("managed.known"), 1).when(F.col("usual.known"), 2).otherwise(3)
    best = F.coalesce("exact", "managed", "usual", "other")
    return met.select("query_id", F.col("stage").alias("matched_stage"), priority.alias("priority"), best["kc"].alias("kc"))


def next_crops(crops: DataFrame, rules: DataFrame) -> DataFrame:
    """previous, candidate: all crops less those that a restriction forbids after the previous one; a rule without effect restricts."""
    restricted = rules.where(F.coalesce("effect", F.lit("restriction")) == "restriction").select(F.col("crop_a").alias("previous"), F.col("crop_b").alias("candidate"))
    every = crops.select(F.col("crop").alias("previous"), F.lit(1).alias("k")).join(crops.select(F.col("crop").alias("candidate"), F.lit(1).alias("k")), "k").drop("k")
    return every.where("previous <> candidate").join(restricted, ["previous", "candidate"], "left_anti")


def fertilizer_need(soil: DataFrame, uptake: DataFrame) -> DataFrame:
    """Per parcel and element: deficient below half of the stage's uptake, adequate below all of it, else sufficient."""
    status = F.when(F.col("available") < F.col("uptake") * 0.5, "deficient").when(F.col("available") < F.col("uptake"), "adequate").otherwise("sufficient")
    gap = F.greatest(F.lit(0.0), F.col("uptake") - F.col("available"))
    return soil.join(uptake, ["crop", "element"]).withColumn("status", F.when(F.col("available").isNotNull(), status).otherwise("unknown")).withColumn("gap", F.round(gap, 2))


def gdd_from_normals(species: DataFrame, climates: DataFrame) -> DataFrame:
    """Degree days from sowing to anthesis for each species and climate, from monthly normals.

    ``species``: species, base_temp, sow_month, anthesis_month; ``climates``: climate, temps (twelve). The first and last
    month count half (15 days), the months between whole, and the year wraps.
    """
    days = F.array(*(F.lit(d) for d in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)))
    span = F.pmod(F.col("anthesis_month") - F.col("sow_month"), F.lit(12))
    months = species.withColumn("step", F.explode(F.sequence(F.lit(0), span))).withColumn("span", span)
    month = F.pmod(F.col("sow_month") - 1 + F.col("step"), F.lit(12)) + 1
    length = F.when((F.col("step") == 0) | (F.col("step") == F.col("span")), 15).otherwise(F.element_at(days, F.col("month")))
    one = F.lit(1).alias("k")  # both are reference tables of a few rows: species by climates is the result itself
    grid = months.withColumn("month", month.cast("int")).withColumn("length", length).withColumn("k", one).join(climates.withColumn("k", one), "k")
    heat = F.greatest(F.lit(0.0), F.element_at("temps", F.col("month")) - F.col("base_temp")) * F.col("length")
    return grid.groupBy("species", "climate").agg(F.round(F.sum(heat), 0).alias("gdd"))


def cover_crops(crops: DataFrame, management: str | Column = "any", min_biomass: float = 2.0, max_cn: float | None = 20.0, frost_days: str = "frost_days") -> DataFrame:
    """Cover crops with the biomass to expect and whether they suit, for one management or a column of them (null: any).

    Organic farming gets 0.8 of what conventional or unspecified sources report; conventional farming leaves
    organic-only sources out. Frost matters only where there is any.
    """
    way = F.coalesce(F.lit(management) if isinstance(management, str) else management, F.lit("any"))
    crops = crops.where((way != "conventional") | (F.col("source_management") != "organic"))
    reduced = (way == "organic") & F.col("source_management").isin("conventional", "unspecified")
    biomass = F.when(reduced, F.col("biomass_t_ha") * 0.8).otherwise(F.col("biomass_t_ha"))
    bad = (biomass < min_biomass) | ((F.col(frost_days) > 0) & F.coalesce(F.col("frost_tolerance_c") > -5, F.lit(False)))
    if max_cn is not None:
        bad = bad | F.coalesce(F.col("c_n_ratio") > max_cn, F.lit(False))
    return crops.withColumn("target_biomass", F.round(biomass, 1)).withColumn("suitable", ~bad)


def observed_stats(rows: DataFrame, harvest_index: float = 0.45, min_n: int = 3) -> DataFrame:
    """Per crop and climate the management with most records: its yield statistics and the biomass they imply."""
    good = rows.where("yield_kg_ha > 0 AND NOT is_guide")
    stats = good.groupBy("crop", "climate_class", "management").agg(
        F.round(F.avg("yield_kg_ha"), 1).alias("mean_yield"), F.min("yield_kg_ha").alias("min_yield"), F.max("yield_kg_ha").alias("max_yield"), F.count(F.lit(1)).alias("n")
    )
    best = Window.partitionBy("crop", "climate_class").orderBy(F.desc("n"), "management")
    biomass = F.round(F.col("mean_yield") / (harvest_index * 1000), 2)
    return stats.withColumn("__r", F.row_number().over(best)).where(F.col("__r") == 1).drop("__r").withColumn("biomass_t_ha", biomass).withColumn("overrides", F.col("n") >= min_n)


def composite_scores(crops: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """score = sum of weight x figure / largest figure among the candidates of the key, in percent of all weights."""
    whole = Window.partitionBy(*keys)
    total = sum(weights.values())
    parts = [F.lit(100.0 * w / total) * F.coalesce(F.try_divide(F.greatest(F.col(c), F.lit(0.0)), F.nullif(F.max(c).over(whole), F.lit(0.0))), F.lit(0.0)) for c, w in weights.items()]
    return crops.withColumn("score", F.round(reduce(lambda a, b: a + b, parts), 1))


def optimise_rotation(parcels: DataFrame, scores: DataFrame, years: int, alternatives: int = 3) -> DataFrame:
    """parcel_id, year_no, crop, score, alternatives: each year the best allowed successor of the year before.

    ``scores``: previous, crop, score holds the allowed successors with their score; ``parcels`` has parcel_id and
    previous. At most six years, each one join with the successor table. A parcel without successor stops.
    """
    if not 1 <= years <= 6:
        raise ValueError("a rotation has one to six years")
    ranked = scores.groupBy("previous").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "crop"))).alias("options"))
    plan = None
    now = parcels.select("parcel_id", "previous")
    for year in range(1, years + 1):
        chosen = now.join(ranked, "previous").select(
            "parcel_id", F.lit(year).alias("year_no"), F.get("options", F.lit(0))["crop"].alias("crop"), (-F.get("options", F.lit(0))["minus"]).alias("score"),
            F.transform(F.slice("options", 2, alternatives), lambda o: o["crop"]).alias("alternatives"),
        )
        plan = chosen if plan is None else plan.unionAll(chosen)
        now = chosen.select("parcel_id", F.col("crop").alias("previous"))
    return plan


def compliance(plan: DataFrame) -> DataFrame:
    """Points of a rotation out of 100 by five rules; one rule can't be scored from a plan and gives nothing.

    ``plan``: parcel_id, crop, legume, cover, slope_pct.
    """
    kinds = F.count_distinct("crop")
    rows = plan.groupBy("parcel_id").agg(
        F.when(kinds >= 3, 20).when(kinds == 2, 10).otherwise(0).alias("diversity"),
        F.when(F.count_if("legume") > 0, 20).otherwise(0).alias("legumes"),
        F.when(F.count_if("cover") > 0, 25).otherwise(0).alias("cover"),
        F.when(F.max("slope_pct") < 10, 20).otherwise(0).alias("erosion"),
    )
    return rows.withColumn("score_pct", F.round(F.lit(100.0) * (F.col("diversity") + F.col("legumes") + F.col("cover") + F.col("erosion")) / 100, 0).cast("int"))


def nitrogen_balance(plan: DataFrame) -> DataFrame:
    """Soil nitrogen after each year: max(0, pool + fixed - required), from zero on; ``plan``: parcel_id, year_no, fixed, required."""
    steps = F.array_sort(F.collect_list(F.struct("year_no", "fixed", "required")))
    pool = F.aggregate(
        "steps",
        F.array().cast("array<double>"),
        lambda acc, x: F.array_append(acc, F.greatest(F.lit(0.0), F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x["fixed"] - x["required"])),
    )
    return plan.groupBy("parcel_id").agg(steps.alias("steps")).withColumn("pool", pool).select(
        "parcel_id", F.posexplode(F.arrays_zip(F.col("steps.year_no").alias("year_no"), F.col("pool").alias("soil_n"))).alias("p", "x")
    ).select("parcel_id", F.col("x.year_no").alias("year_no"), F.col("x.soil_n").alias("soil_n"))


def season_simulation(weather: DataFrame, tsum1: float = 1100.0, tsum2: float = 900.0, base: float = 0.0, awc: float = 140.0) -> DataFrame:
    """parcel_id, days, gdd, stress: a daily soil water balance with yield stress until maturity.

    ``weather``: parcel_id, day, tmin, tmax, precip, eto. A fold over the sorted days of each parcel, since water is
    clamped every day; missing figures have defaults, a missing or zero eto is 3.5.
    """
    bounds = [(0.0, 0.35, 0.4), (tsum1 * 0.2, 0.70, 0.55), (tsum1, 1.15, 0.65), (tsum1 + tsum2 * 0.6, 0.40, 0.4)]

    def by_stage(gdd: Column, index: int) -> Column:
        value = F.lit(bounds[0][index])
        for b in bounds[1:]:
            value = F.when(gdd >= b[0], F.lit(b[index])).otherwise(value)
        return value

    def step(acc: Column, w: Column) -> Column:
        gdd = acc["gdd"] + F.greatest(F.lit(0.0), (F.coalesce(w["tmin"], F.lit(10.0)) + F.coalesce(w["tmax"], F.lit(20.0))) / 2 - base)
        done = acc["done"] | (gdd >= tsum1 + tsum2)
        etc = by_stage(gdd, 1) * F.coalesce(F.nullif(w["eto"], F.lit(0.0)), F.lit(3.5))
        water = F.greatest(F.lit(0.0), F.least(F.lit(awc), acc["water"] + F.coalesce(w["precip"], F.lit(0.0)) - etc))
        share = water / awc
        stress = F.when(share < 0.5, F.greatest(F.lit(0.3), F.least(F.lit(1.0), F.lit(1.0) - by_stage(gdd, 2) * (F.lit(1.0) - share / 0.5)))).otherwise(1.0)
        new = F.struct(gdd.alias("gdd"), water.alias("water"), (acc["stress"] * stress).alias("stress"), (acc["days"] + 1).alias("days"), F.lit(False).alias("done"))
        stop = F.struct(F.when(acc["done"], acc["gdd"]).otherwise(gdd).alias("gdd"), acc["water"].alias("water"), acc["stress"].alias("stress"), acc["days"].alias("days"), F.lit(True).alias("done"))
        return F.when(done, stop).otherwise(new)

    start = F.struct(F.lit(0.0).alias("gdd"), F.lit(awc * 0.7).alias("water"), F.lit(1.0).alias("stress"), F.lit(0).alias("days"), F.lit(False).alias("done"))
    days = F.array_sort(F.collect_list(F.struct("day", *(F.col(c).cast("double").alias(c) for c in ("tmin", "tmax", "precip", "eto")))))
    rows = weather.groupBy("parcel_id").agg(days.alias("d")).withColumn("r", F.aggregate("d", start, step))
    return rows.select("parcel_id", "r.days", F.round("r.gdd", 1).alias("gdd"), F.round("r.stress", 3).alias("stress"))


def yield_projection(stages: DataFrame) -> DataFrame:
    """parcel_id, factor: product over the stages from the current one on of 1 - ky * 0.15, each within 0.3 and 1."""
    each = F.greatest(F.lit(0.3), F.least(F.lit(1.0), F.lit(1.0) - F.col("ky") * (1 - 0.85)))
    return stages.where("stage_no >= current_stage").groupBy("parcel_id").agg(F.round(F.product(each), 4).alias("factor"))


def shared_pests(left: DataFrame, right: DataFrame, k: int = 10) -> DataFrame:
    """crop_a, crop_b, shared, n, risk for pairs of crops with a pest in common; joined by pest, so other pairs never meet."""
    both = left.select(F.col("crop").alias("crop_a"), "pest").distinct().join(right.select(F.col("crop").alias("crop_b"), "pest").distinct(), "pest").where("crop_a < crop_b")
    first = both.withColumn("place", F.row_number().over(Window.partitionBy("crop_a", "crop_b").orderBy("pest")))
    rows = first.groupBy("crop_a", "crop_b").agg(F.sort_array(F.collect_list(F.when(F.col("place") <= k, F.col("pest")))).alias("shared"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("risk", F.when(F.col("n") >= 5, "high").when(F.col("n") >= 2, "medium").otherwise("low"))


def series_trend(points: DataFrame, dead_band: float = 0.02) -> DataFrame:
    """entity, first, last, trend: the change from the first to the last known value, flat within the band."""
    rows = points.where("value IS NOT NULL").groupBy("entity_id").agg(
        F.min_by("value", F.struct("ts", "value")).alias("first_value"), F.max_by("value", F.struct("ts", "value")).alias("last_value"), F.count(F.lit(1)).alias("n")
    )
    change = F.col("last_value") - F.col("first_value")
    return rows.withColumn("trend", F.when(change > dead_band, "up").when(change < -dead_band, "down").otherwise("flat"))


def plan_warnings(segments: DataFrame) -> DataFrame:
    """plan_id, kind, seq_a, seq_b: unknown roles and methods, and segments of a plan whose sowing windows overlap.

    Segments meet in the months that they share, each pair in its first one; so a plan of many segments is spread over its months.
    A segment that ends before it starts overlaps nothing.
    """
    role = segments.where(F.col("role").isNotNull() & ~F.col("role").isin("main", "cover", "catch", "companion")).select("plan_id", F.lit("invalid_role").alias("kind"), F.col("seq").alias("seq_a"), F.lit(None).cast("int").alias("seq_b"))
    how = segments.where(F.col("method").isNotNull() & ~F.col("method").isin("harvest", "roller_crimper", "mowing", "grazing", "incorporation")).select("plan_id", F.lit("invalid_termination_method"), "seq", F.lit(None).cast("int"))
    months = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / 30)
    whole = segments.where("start <= end").withColumn("first", months("start")).withColumn("month", F.explode(F.sequence("first", months("end"))))
    a, b = (whole.select("plan_id", "month", *(F.col(c).alias(f"{c}_{side}") for c in ("seq", "start", "end", "first"))) for side in "ab")
    overlap = a.join(b, ["plan_id", "month"]).where("seq_a < seq_b AND start_a <= end_b AND start_b <= end_a AND month = greatest(first_a, first_b)")
    overlap = overlap.select("plan_id", F.lit("window_overlap"), "seq_a", "seq_b")
    return role.unionAll(how).unionAll(overlap)
