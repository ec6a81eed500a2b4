"""A cover crop and the protein crop after it, for a table of parcels: choices are made per zone, and parcels meet only their zone's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import agronomy as A
from harrow.operators.crops import n_fixation_estimate, sequence_dates
from harrow.operators.decisions import cover_crops
from harrow.operators.varieties import in_zones, top_per_group
from harrow.sources.scratch import written

#: What a degree-day sum is taken to be where it isn't known.
COVER_GDD, PROTEIN_GDD = 1250.0, 1400.0


def zone_climate(sites: DataFrame) -> DataFrame:
    """climate_class, rainfall, frost_days (zero if unknown), et0, sites: means over a zone's sites, to one decimal. Sites without a class are left out."""
    mean = lambda c: F.round(F.avg(c), 1)
    return sites.where("climate_class IS NOT NULL").groupBy("climate_class").agg(
        mean("rainfall").alias("rainfall"), F.coalesce(mean("frost_days"), F.lit(0.0)).alias("frost_days"), mean("et0").alias("et0"), F.count(F.lit(1)).alias("sites")
    )


def zone_covers(covers: DataFrame, zones: DataFrame, most: int = 4) -> DataFrame:
    """climate_class, management, choices: the ``most`` suitable cover crops of a zone for each management, most biomass first."""
    ways = F.explode(F.array(*map(F.lit, ("any", "organic", "conventional")))).alias("management")
    asked = covers.join(zones.select("climate_class", "frost_days"), "climate_class").select("*", ways)
    good = cover_crops(asked, F.col("management")).where("suitable")
    first = top_per_group(good, ["climate_class", "management"], [F.desc("target_biomass"), F.col("cover")], most)
    choice = F.struct("rank", "cover", "target_biomass", "c_n_ratio", "cover_type", "n_content_pct", "n_fixation_kg_ha", "cover_gdd")
    return first.groupBy("climate_class", "management").agg(F.array_sort(F.collect_list(choice)).alias("choices"))


def zone_varieties(sites: DataFrame, trials: DataFrame, links: DataFrame, crops: DataFrame, now_year: int, most: int = 5, half_life: float = 8.0) -> DataFrame:
    """climate_class, crop, varieties: the ``most`` best varieties (variety, mean_yield) of each crop over a zone's sites.

    Sites of a zone weigh the same, so a record counts once for each zone its trial has sites in; as in ``rank_for_targets``, records of
    one trial that differ in their scores are two. They are added up where they lie, so only sums by zone, crop and variety are moved on.
    """
    zones = sites.where("climate_class IS NOT NULL").select("site_id", "climate_class")
    records = trials.dropna(subset=["crop", "variety_norm"]).select("trial_id", "crop", F.col("variety_norm").alias("variety"), "year", "yield_kg_ha", F.to_json("scores").alias("scores"))
    age, known = F.lit(now_year) - F.col("year"), F.col("yield_kg_ha")
    recency = F.when(age > 0, F.pow(F.lit(0.5), age / half_life)).otherwise(1.0)
    mean = F.try_divide(F.sum(recency * known), F.nullif(F.sum(F.when(known.isNotNull(), recency)), F.lit(0.0)))
    rows = in_zones(records, links, zones).groupBy("climate_class", "crop", "variety").agg(F.round(F.round(mean, 6), 1).alias("mean_yield"))
    ranked = top_per_group(written(rows, "zone-varieties").join(crops.select("crop"), "crop", "left_semi"), ["climate_class", "crop"], [F.col("mean_yield").desc_nulls_last(), F.col("variety")], most)
    found = F.array_sort(F.collect_list(F.struct("rank", "variety", "mean_yield")))
    return ranked.where("mean_yield IS NOT NULL").groupBy("climate_class", "crop").agg(found.alias("varieties"))


def regenerative_sequences(parcels: DataFrame, sites: DataFrame, covers: DataFrame, proteins: DataFrame, trials: DataFrame, links: DataFrame, now_year: int, year: int = 2026) -> DataFrame:
    """Each parcel's plan: the zone's best cover crop, its nitrogen, the best variety of the asked protein crop, dates, water and carbon.

    ``parcels``: parcel_id, climate_class, crop, management (null: any), awc, soc, soc_target. ``covers``: climate_class, cover, biomass_t_ha,
    c_n_ratio, frost_tolerance_c, source_management, cover_type, n_content_pct, n_fixation_kg_ha, cover_gdd. ``proteins``: crop,
    harvest_index, protein_content_pct, gdd (map by class), not_viable (array of classes), one row a crop.

    ``status`` is ok, unknown_crop, not_viable or no_cover; all figures of the last three are null, and so are yields where
    a zone has no trial of the crop. Plans are worked out once for each zone, crop and management that is asked for, and parcels add
    what only they have. A zone without sites has no climate, so no cover crop. Parcels are kept as they are, repeated ones too.
    """
    zones = written(zone_climate(sites), "zones")
    asked = parcels.select("climate_class", "crop", F.coalesce("management", F.lit("any")).alias("management")).distinct()
    best = zone_varieties(sites, trials, links, proteins, now_year)
    known = proteins.select("crop", "harvest_index", "protein_content_pct", "gdd", "not_viable", F.lit(True).alias("known"))
    rows = asked.join(known, "crop", "left").join(zone_covers(covers, zones), ["climate_class", "management"], "left").join(best, ["climate_class", "crop"], "left")
    status = F.when(F.col("known").isNull(), "unknown_crop").when(F.array_contains("not_viable", F.col("climate_class")), "not_viable").when(F.col("choices").isNull(), "no_cover").otherwise("ok")
    rows = rows.withColumn("status", status).withColumn("choice", F.explode_outer(F.when(F.col("status") == "ok", F.col("choices"))))
    top = F.get("varieties", F.lit(0))
    rows = rows.select(
        "climate_class", "crop", "management", "status", "harvest_index", "protein_content_pct", F.when(F.col("status") == "ok", F.col("varieties")).alias("varieties"), "choice.*",
        F.col("choice.target_biomass").alias("cover_biomass_t_ha"), F.when(F.col("status") == "ok", top["variety"]).alias("protein_variety"), F.when(F.col("status") == "ok", top["mean_yield"]).alias("protein_yield_kg_ha"),
        F.coalesce(F.try_element_at("gdd", F.col("climate_class")), F.lit(PROTEIN_GDD)).alias("protein_gdd"),
    ).withColumn("cover_gdd", F.when(F.col("cover").isNotNull(), F.coalesce("cover_gdd", F.lit(COVER_GDD))))
    rows = sequence_dates(n_fixation_estimate(rows), year)
    keys = ["climate_class", "crop", "management"]
    other = F.struct("rank", "cover", F.col("cover_biomass_t_ha").alias("biomass_t_ha"), "c_n_ratio", "n_cover_available_kg_ha", "cover_type")
    dates = ["cover_crop_sowing_date", "termination_date", "protein_crop_sowing_date", "protein_crop_harvest_date"]
    shown = ["status", "cover", "cover_type", "cover_biomass_t_ha", "c_n_ratio", "cover_gdd", "n_cover_total_kg_ha", "n_cover_available_kg_ha", "n_protein_fixed_kg_ha", "protein_variety", "protein_yield_kg_ha", "protein_kg_ha", "varieties", *dates]
    plans = rows.groupBy(*keys).agg(  # at most four rows a group
        F.min_by(F.struct(*(F.when(F.col("cover").isNotNull(), F.col(c)).alias(c) if c in dates else F.col(c) for c in shown)), F.coalesce("rank", F.lit(0))).alias("plan"),
        F.array_sort(F.collect_list(F.when(F.col("rank") > 1, other))).alias("alternatives"),
    )
    plans = written(plans.select(*keys, "plan.*", "alternatives"), "zone-plans")
    met = parcels.withColumn("management", F.coalesce("management", F.lit("any"))).alias("p")
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"z.{k}")) for k in keys]
    met = met.join(plans.alias("z"), on, "left").select("p.*", *(F.col(f"z.{c}") for c in [*shown, "alternatives"]))
    met = met.join(zones.select("climate_class", F.col("rainfall").alias("zone_rainfall"), F.col("et0").alias("zone_et0")), "climate_class", "left")
    ok = F.col("status") == "ok"
    water = A.water_risk(F.col("zone_rainfall"), F.col("zone_et0"), F.col("awc"))
    return met.withColumns({
        "organic_yield_kg_ha": F.when(F.col("management") == "organic", F.bround(F.col("protein_yield_kg_ha") * 0.8)),
        "water_deficit_mm": F.when(ok, water["deficit_mm"]), "water_risk": F.when(ok, water["risk"]),
        **A.carbon(F.col("cover_biomass_t_ha"), F.col("soc"), F.col("soc_target")),
    }).drop("zone_rainfall", "zone_et0")
