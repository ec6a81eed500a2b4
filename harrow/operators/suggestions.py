"""Crops suggested for parcels, and rotations of several years from a pool of crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.nearby import nearest_sites, rank_for_targets
from harrow.operators.parts import holding
from harrow.sources.scratch import written

#: Points of a crop's score: for its yield and margin relative to the parcel's best, for carbon, and for the soil (fixed values).
YIELD_POINTS, MARGIN_POINTS, CARBON_POINTS = 40, 30, 20
SOIL_POINTS = {"suitable": 10, "warning": 5}
#: Operations of a crop whose number isn't known, and the share of a conventional yield that organic growing reaches (fixed values).
OPERATIONS, ORGANIC_SHARE = 5, 0.8
#: Days of a season that isn't known, share of rain that crops can use, and water of a soil that isn't known in mm (fixed values).
SEASON_DAYS, USABLE_RAIN, SOIL_WATER = 180, 0.7, 100.0
#: Bounds of a rotation's years, successors that a pool takes, and soil nitrogen at first: for a percent of organic matter, and if unknown (fixed values).
YEARS, SUCCESSORS, NITROGEN_OF_MATTER, NITROGEN = (2, 6), 10, 15, 50.0
#: What a parcel's environment is known by.
ENVIRONMENT = ("rainfall", "et0", "frost", "elevation", "climate_class")
ANY = "\0any"


def _round(value: Column, digits: int) -> Column:
    """Rounded halves away from zero, after what differs by the order of sums is gone."""
    return F.round(F.round(value, 6), digits)


def suggest_crops(
    parcels: DataFrame, crops: DataFrame, trials: DataFrame, links: DataFrame, sites: DataFrame, now_year: int,
    top_n: int = 15, site_limit: int = 50, seed_price: float = 1.0, price_per_t: float = 1.0, operation_cost: float = 1.0,
) -> DataFrame:
    """parcel_id, rank, crop, the best variety and its yield, margins, soil, frost and water of each parcel's best crops.

    ``parcels``: parcel_id, rainfall, et0, frost, elevation, climate_class, season (null: any), management, area_ha, ph, texture, awc_mm.
    ``crops``, one row each: crop, slots (an array of seasons), season_days, ph_min, ph_max, textures, frost_damage_c. ``trials`` are usable.
    A crop of the parcel's season is suggested if a variety with a yield was tried near sites of such an environment; all crops are
    looked at. Soil without ph and texture, and crops without demands, are ``unknown``. Ties of the score go to the name.

    Varieties are ranked once for each environment and crop that some parcel asks for, so parcels of one environment share the work
    and then meet a row for each crop. A null in an environment is a value of its own here.
    """
    known = ["parcel_id", *ENVIRONMENT, "season", "management", "area_ha", "ph", "texture", "awc_mm"]
    parcels = parcels.select(*known, F.xxhash64(F.to_json(F.struct(*ENVIRONMENT))).alias("target_id"))
    environments = written(parcels.select("target_id", *ENVIRONMENT).distinct(), "environments")
    seasons = parcels.select("target_id", F.coalesce("season", F.lit(ANY)).alias("season")).distinct()
    offered = crops.select("crop", F.explode(F.array_append(F.coalesce("slots", F.array().cast("array<string>")), F.lit(ANY))).alias("season"))
    wanted = seasons.join(offered, "season").select("target_id", "crop").distinct()
    near = nearest_sites(environments, sites, site_limit)
    best = rank_for_targets(wanted, near, trials, links, now_year, top_n=1).where("mean_yield IS NOT NULL")
    best = best.select("target_id", "crop", "variety", F.col("mean_yield").cast("double").alias("yield_kg_ha"), "trial_count")
    asked = parcels.join(best, "target_id").join(crops, "crop").where(F.col("season").isNull() | F.array_contains("slots", F.col("season")))
    return _scored(asked, top_n, seed_price + operation_cost * OPERATIONS, price_per_t)


def _scored(asked: DataFrame, top_n: int, cost: float, price_per_t: float) -> DataFrame:
    """The rows' margins, risks and score, and the best of each parcel; a parcel has at most a row for each crop."""
    soil_known = F.col("ph").isNotNull() | F.col("texture").isNotNull()
    demands = F.col("ph_min").isNotNull() | F.col("textures").isNotNull()
    acid = F.col("ph").isNotNull() & F.col("ph_min").isNotNull() & ~(F.col("ph").between(F.col("ph_min"), F.coalesce("ph_max", F.lit(14.0))))
    fits = F.exists("textures", lambda t: F.lower(F.col("texture")).contains(F.lower(t)))
    coarse = F.col("texture").isNotNull() & (F.size("textures") > 0) & ~fits
    problems = F.array_compact(F.array(F.when(acid, "ph"), F.when(coarse, "texture")))
    rows = asked.withColumn("soil_problems", F.when(soil_known & demands, problems).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("soil", F.when(~(soil_known & demands), "unknown").when(F.size("soil_problems") == 0, "suitable").otherwise("warning"))
    organic = F.coalesce(F.col("management") == "organic", F.lit(False))
    demand = F.coalesce("season_days", F.lit(SEASON_DAYS)) / 365 * F.col("et0")
    lack = F.when((F.col("et0") != 0) & (F.col("rainfall") != 0), F.greatest(F.lit(0.0), demand - F.col("rainfall") * USABLE_RAIN))
    water = F.coalesce("awc_mm", F.lit(SOIL_WATER))
    rows = rows.withColumns({
        "margin_eur_ha": _round(F.col("yield_kg_ha") / 1000 * price_per_t - cost, 2),
        "organic_yield_kg_ha": F.when(organic, F.bround(F.round(F.col("yield_kg_ha") * ORGANIC_SHARE, 6), 0)),
        "frost_risk": F.coalesce((F.col("frost_damage_c") > -5) & (F.col("frost") > 5), F.lit(False)),
        "water_deficit_mm": _round(lack, 1),
        "water_ratio": F.when(lack.isNotNull(), F.when(water > 0, lack / water).otherwise(999.0)),
    })
    rows = rows.withColumns({
        "organic_margin_eur_ha": _round(F.col("organic_yield_kg_ha") / 1000 * price_per_t - cost, 2),
        "parcel_margin_eur": F.when(F.col("area_ha") > 0, _round(F.col("margin_eur_ha") * F.col("area_ha"), 2)),
        "water_demand": F.when(F.col("water_ratio") < 0.5, "low").when(F.col("water_ratio") < 1.5, "medium").when(F.col("water_ratio").isNotNull(), "high"),
        "gaps": F.array_compact(F.array(F.when(F.col("trial_count") < 3, "few_trials"), F.when(organic, "conventional_trials"), F.when(~soil_known, "no_soil"))),
    })
    whole = Window.partitionBy("parcel_id")
    of_best = lambda c: F.col(c) / F.coalesce(F.nullif(F.max(c).over(whole), F.lit(0.0)), F.lit(1.0))
    soil_points = F.when(F.col("soil") == "suitable", SOIL_POINTS["suitable"]).when(F.col("soil") == "warning", SOIL_POINTS["warning"]).otherwise(0)
    rows = rows.withColumn("score", _round(of_best("yield_kg_ha") * YIELD_POINTS + of_best("margin_eur_ha") * MARGIN_POINTS + CARBON_POINTS + soil_points, 1))
    rows = rows.withColumn("rank", F.row_number().over(whole.orderBy(F.col("score").desc(), "crop"))).where(F.col("rank") <= top_n)
    return rows.select(
        "parcel_id", "rank", "crop", "score", "variety", "yield_kg_ha", "organic_yield_kg_ha", "trial_count", "margin_eur_ha", "organic_margin_eur_ha", "parcel_margin_eur",
        "soil", "soil_problems", "frost_risk", "water_demand", "water_deficit_mm", F.round("water_ratio", 2).alias("water_ratio"), "gaps",
    )


def rotation_plans(
    parcels: DataFrame, successors: DataFrame, crops: DataFrame, forbidden: DataFrame, pests: DataFrame, start: str = "none",
    seed_price: float = 1.0, harvest_price: float = 1.0, operation_cost: float = 1.0,
) -> DataFrame:
    """parcel_id, status, initial_n, plan (an array of a struct for each year), and totals: the pool of a parcel's crop, year after year.

    ``parcels``: parcel_id, starting_crop (null: the pool of ``start``), years, organic_matter_pct. ``successors``: previous, crop, place; the
    first ten make a pool, after the starting crop. ``crops``, one row each: crop, variety, yield_kg_ha, carbon, fixed_n, required_n, operations;
    unknown figures count as none, unknown operations as five. ``forbidden``: crop_a, crop_b, reason; ``pests``: crop_a, crop_b, n, risk in
    either order, as ``decisions.shared_pests`` gives them. Years outside two to six give the status ``years``, an empty pool ``no_crops``.

    Soil nitrogen never falls below zero; a year's balance counts what the soil holds from the second year on. Pools, what
    follows what in them, its reasons and its pests are worked out once for each starting crop, so a parcel meets one row and the fold
    over its years needs no shuffle.
    """
    pools = written(_pools(parcels, successors, crops, forbidden, pests, start), "rotation-pools")
    begun = parcels.withColumn("pool_of", F.coalesce("starting_crop", F.lit(start))).join(pools, "pool_of", "left")
    initial = F.coalesce(F.round(F.col("organic_matter_pct").try_cast("double") * NITROGEN_OF_MATTER, 1), F.lit(NITROGEN))
    status = F.when(~F.coalesce(F.col("years").between(*YEARS), F.lit(False)), "years").when(F.coalesce(F.size("pool"), F.lit(0)) <= 0, "no_crops").otherwise("ok")
    begun = begun.select("parcel_id", "years", "pool", status.alias("status"), initial.alias("initial_n"))
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))

    def year(acc: Column, i: Column) -> Column:
        crop = F.get("pool", (i % F.size("pool")).cast("int"))
        fixed, required, held = number(crop["fixed_n"]), number(crop["required_n"]), acc["held"]
        cost = F.lit(seed_price) + F.coalesce(crop["operations"], F.lit(OPERATIONS)) * F.lit(operation_cost)
        after, again = F.greatest(F.lit(0.0), held + fixed - required), i > 0
        row = F.struct(
            (i + 1).cast("int").alias("year_no"), crop["crop"].alias("crop"), crop["variety"].alias("variety"), number(crop["yield_kg_ha"]).alias("yield_kg_ha"), number(crop["carbon"]).alias("carbon"),
            (number(crop["yield_kg_ha"]) * F.lit(harvest_price) - cost).alias("margin_eur_ha"), (fixed - required + F.when(again, held).otherwise(0.0)).alias("n_balance"), after.alias("soil_n"),
            F.when(again, crop["reason"]).alias("reason"), F.when(again, F.coalesce(crop["pests"], F.lit(0))).otherwise(0).cast("long").alias("shared_pests"),
            F.when(again, F.coalesce(crop["risk"], F.lit("none"))).otherwise("none").alias("pest_risk"),
        )
        return F.struct(after.alias("held"), F.array_append(acc["plan"], row).alias("plan"))

    shape = "array<struct<year_no:int,crop:string,variety:string,yield_kg_ha:double,carbon:double,margin_eur_ha:double,n_balance:double,soil_n:double,reason:string,shared_pests:bigint,pest_risk:string>>"
    ok = F.col("status") == "ok"
    first = F.struct(F.col("initial_n").alias("held"), F.array().cast(shape).alias("plan"))
    folded = begun.withColumn("folded", F.when(ok, F.aggregate(F.sequence(F.lit(0), F.col("years").cast("int") - 1), first, year)))
    total = lambda c: F.aggregate(F.col("folded.plan")[c], F.lit(0.0), lambda a, x: a + x)
    return folded.select(
        "parcel_id", "status", F.when(ok, F.col("initial_n")).alias("initial_n"), F.coalesce("folded.plan", F.array().cast(shape)).alias("plan"),
        _round(total("yield_kg_ha"), 1).alias("total_yield_kg_ha"), _round(total("carbon"), 2).alias("total_carbon"), _round(total("margin_eur_ha"), 2).alias("total_margin_eur_ha"),
        _round(F.col("folded.held"), 1).alias("final_n"),
    )


def _pools(parcels: DataFrame, successors: DataFrame, crops: DataFrame, forbidden: DataFrame, pests: DataFrame, start: str) -> DataFrame:
    """pool_of, pool: the crops of each starting crop in their order, with what each meets after the one before it (the first: the last)."""
    order = Window.partitionBy("previous").orderBy("place", "crop")
    follow = successors.where("crop IS NOT NULL").withColumn("i", F.row_number().over(order)).where(F.col("i") <= SUCCESSORS).select(F.col("previous").alias("pool_of"), "i", "crop")
    begun = parcels.where(F.col("starting_crop").isNotNull()).select(F.col("starting_crop").alias("pool_of")).distinct().select("pool_of", F.lit(0).alias("i"), F.col("pool_of").alias("crop"))
    rows = follow.unionByName(begun)
    inside = Window.partitionBy("pool_of").orderBy("i")
    last = F.last("crop").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("before", F.coalesce(F.lag("crop").over(inside), last))
    reasons = forbidden.groupBy(F.col("crop_a").alias("before"), F.col("crop_b").alias("crop")).agg(F.min(F.coalesce("reason", F.lit("not after this crop"))).alias("reason"))
    both = pests.select(F.col("crop_a").alias("before"), F.col("crop_b").alias("crop"), F.col("n").alias("pests"), "risk")
    both = both.unionByName(pests.select(F.col("crop_b").alias("before"), F.col("crop_a").alias("crop"), F.col("n").alias("pests"), "risk"))
    figures = crops.select("crop", "variety", "yield_kg_ha", "carbon", "fixed_n", "required_n", "operations")
    rows = rows.join(figures, "crop", "left").join(reasons, ["before", "crop"], "left").join(both, ["before", "crop"], "left")
    one = F.struct("i", "crop", "variety", "yield_kg_ha", "carbon", "fixed_n", "required_n", "operations", "reason", "pests", "risk")
    return rows.groupBy("pool_of").agg(F.array_sort(F.collect_list(one)).alias("pool"))


def rotation_years(plans: DataFrame) -> DataFrame:
    """A row for each year of the plans."""
    return plans.select("parcel_id", F.explode("plan").alias("year")).select("parcel_id", "year.*").withColumns({c: _round(F.col(c), d) for c, d in (("yield_kg_ha", 1), ("margin_eur_ha", 2), ("n_balance", 1), ("soil_n", 1))})


def soil_and_climate(environments: DataFrame, soils: DataFrame, sites: DataFrame, reanalysis: DataFrame) -> DataFrame:
    """``environments`` with the soil's group and the climate that is known best.

    ``environments``: parcel_id, climate_class (of a site nearby, or null); ``soils``: parcel_id, texture; ``sites``: site_id, soil_texture,
    soil_type; ``reanalysis``: parcel_id, climate_class, frost_days, rainfall, et0. Adds texture, soil_group (the type of the smallest
    site_id whose texture holds the parcel's, case counting), soil_source, frost_days, rainfall, et0 and climate_source; a class of
    the reanalysis goes before that of the site, and without one the site's stays. One row for each of ``environments``.

    Textures are compared once for each distinct one, through their pieces.
    """
    named = sites.where("soil_texture IS NOT NULL AND soil_texture <> ''").groupBy("soil_texture").agg(F.min(F.struct("site_id", "soil_type")).alias("site"))
    texture = soils.groupBy("parcel_id").agg(F.min(F.nullif("texture", F.lit(""))).alias("texture")).where("texture IS NOT NULL")
    groups = holding(named, "soil_texture", texture, "texture").join(named, "soil_texture").groupBy("texture").agg(F.min("site")["soil_type"].alias("soil_group"))
    better = reanalysis.groupBy("parcel_id").agg(F.min(F.struct(F.col("climate_class").alias("c"), F.col("frost_days").alias("f"), F.col("rainfall").alias("r"), F.col("et0").alias("e"))).alias("re"))
    rows = environments.join(texture, "parcel_id", "left").join(groups, "texture", "left").join(better, "parcel_id", "left")
    measured = F.col("re").isNotNull()
    climate = F.coalesce("re.c", "climate_class")
    return rows.select(
        *(F.col(c) if c != "climate_class" else climate.alias(c) for c in environments.columns), "texture", "soil_group", F.when(F.col("texture").isNotNull(), "soil_survey").otherwise("unavailable").alias("soil_source"),
        F.col("re.f").alias("frost_days"), F.col("re.r").alias("rainfall"), F.col("re.e").alias("et0"),
        F.when(measured, "reanalysis").when(F.col("climate_class").isNotNull(), "nearby_site").otherwise("unavailable").alias("climate_source"),
    )
