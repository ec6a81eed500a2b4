"""Trials, sites and variety ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import agronomy as A

FEATURES = ("aridity", "rainfall", "frost", "elevation")


@dataclass(frozen=True)
class Target:
    """The environment to rank for; features may be missing, then sites are matched by class or not at all."""

    rainfall: float | None = None
    et0: float | None = None
    frost: float | None = None
    elevation: float | None = None
    climate_class: str | None = None

    def vector(self) -> dict[str, float] | None:
        if None in (self.rainfall, self.et0, self.frost, self.elevation) or not self.et0:
            return None
        return {"aridity": self.rainfall / self.et0, "rainfall": self.rainfall, "frost": self.frost, "elevation": self.elevation}


def usable(trials: DataFrame) -> DataFrame:
    """Trials with a yield or a note that are not excluded from ranking; an unknown flag means eligible."""
    return trials.where((F.col("yield_kg_ha").isNotNull() | F.col("note").isNotNull()) & F.coalesce("eligible", F.lit(True)))


def matching(trials: DataFrame, sites: DataFrame, links: DataFrame, crop: str | None = None, climate_class: str | None = None,
             soil_texture: str | None = None, regime: str | None = None, min_yield: float | None = None,
             rain: tuple[float, float] | None = None, limit: int | None = None) -> DataFrame:
    """Trial records with their sites under optional filters, best yield first, unknown yields last."""
    rows = usable(trials.drop("site_id", "second_site_id"))
    if crop is not None:
        rows = rows.where((F.col("crop") == crop) | F.lower("variety").contains(crop.lower()))
    if regime is not None:
        rows = rows.where(F.col("regime") == regime)
    if min_yield is not None:
        rows = rows.where(F.col("yield_kg_ha") >= min_yield)
    if climate_class is not None:
        sites = sites.where(F.col("climate_class") == climate_class)
    if soil_texture is not None:
        sites = sites.where(F.col("soil_texture") == soil_texture)
    if rain is not None:
        sites = sites.where(F.col("rainfall").between(*rain))
    rows = rows.join(links, "trial_id").join(sites, "site_id").distinct()
    order = [F.col("yield_kg_ha").desc_nulls_last(), "trial_id", "site_id"]
    return rows.orderBy(*order).limit(limit) if limit else rows


def similar_sites(sites: DataFrame, target: Target, limit: int | None = 50) -> DataFrame:
    """site_id, name, distance: nearest sites by weighted, min-max normalised features; those without features but of the
    target's class have the fallback distance, others without are left out. Ties by name, then id."""
    wanted = target.vector()
    if wanted is None:
        rows = sites.where(F.col("climate_class") == target.climate_class) if target.climate_class else sites
        rows = rows.select("site_id", "name", F.lit(None).cast("double").alias("distance"))
        return rows.orderBy("name", "site_id").limit(limit) if limit else rows
    vectors = A.features("rainfall", "et0", "frost_days", "elevation")
    marked = sites.select("site_id", "name", "climate_class", *(v.alias(f"v_{f}") for f, v in vectors.items()))
    bounds = marked.agg(*(F.min(f"v_{f}").alias(f"lo_{f}") for f in FEATURES), *(F.max(f"v_{f}").alias(f"hi_{f}") for f in FEATURES)).first()
    span = {}
    for f in FEATURES:
        lo, hi = (wanted[f] if b is None else b for b in (bounds[f"lo_{f}"], bounds[f"hi_{f}"]))
        span[f] = F.lit(float(max(hi, wanted[f]) - min(lo, wanted[f])))
    distance = A.weighted_distance({f: F.col(f"v_{f}") for f in FEATURES}, {f: F.lit(float(wanted[f])) for f in FEATURES}, span)
    fallback = F.when(F.col("climate_class") == F.lit(target.climate_class), F.lit(A.FALLBACK_DISTANCE))
    ranked = marked.select("site_id", "name", F.round(F.coalesce(distance, fallback), 4).alias("distance")).where("distance IS NOT NULL")
    return ranked.orderBy("distance", "name", "site_id").limit(limit) if limit else ranked


def environment_of(sites: DataFrame, name: str) -> Target | None:
    """The environment of a site known by its name or municipality (the first by id), or None if there is none."""
    wanted = F.lit(name.lower())
    row = sites.where((F.lower("name") == wanted) | (F.lower("municipality") == wanted)).orderBy("site_id").first()
    if row is None:
        return None
    return Target(row["rainfall"], row["et0"], row["frost_days"], row["elevation"], row["climate_class"])


def soil_gate(asked: DataFrame, ranked: DataFrame, tolerance: DataFrame, soils: DataFrame) -> DataFrame:
    """The ranking (crop, variety, ...) for each asked parcel_id and crop, with the soil's verdict and whether it excludes the variety.

    ``tolerance``: crop, ph_min, ph_max, textures, drainages. ``soils``: parcel_id, ph, texture, drainage. A crop without
    tolerance and a parcel without soil give ``unknown``, which excludes nothing; only ``unsuitable`` does.
    """
    parts = A.soil_verdict(*(F.col(c) for c in ("ph", "ph_min", "ph_max", "texture", "textures", "drainage", "drainages")))
    judged = asked.join(tolerance, "crop", "left").join(soils, "parcel_id", "left").select("parcel_id", "crop", parts["verdict"].alias("soil_verdict"))
    return judged.join(ranked, "crop").withColumn("excluded_by_soil", F.col("soil_verdict") == "unsuitable")


def sent_whole(few: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``few``, to be sent to the rows it is joined with if it has at most ``most`` rows, so that these aren't moved; more rows meet by a shuffle."""
    return F.broadcast(few) if few.limit(most + 1).count() <= most else few


def in_zones(records: DataFrame, links: DataFrame, zones: DataFrame) -> DataFrame:
    """Each distinct record of a trial (trial_id and all else that counts) once for every zone that has one of the trial's sites.

    ``zones``: site_id and the zone's columns, one row a site. They are sent to where the links lie (by trial, see ``trial_links``), so
    links aren't moved again and records only once.
    """
    at = links.join(sent_whole(zones), "site_id").drop("site_id")
    return records.repartition("trial_id").join(at, "trial_id").distinct()


def trial_weights(trials: DataFrame, links: DataFrame, sites: DataFrame, now_year: int, half_life: float = 8.0,
                  regime: str | None = None, regime_penalty: float = 0.4, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per trial (and key) with weight w: nearest site x recency x match of the water regime.

    ``sites`` have site_id, name, weight and the keys. A trial linked to several sites, or recorded twice, counts once.
    """
    by_name = sites.groupBy(*keys, "name").agg(F.min("weight").alias("weight")) if "weight" in sites.columns else sites
    placed = sites.select(*keys, "site_id", "name").join(by_name, [*keys, "name"])
    age = F.lit(now_year) - F.col("year")
    recency = F.when(age > 0, F.pow(F.lit(0.5), age / F.lit(half_life))).otherwise(1.0)
    same = F.lit(1.0) if regime is None else F.when(F.col("regime").isNull() | (F.col("regime") == regime), 1.0).otherwise(regime_penalty)
    per_trial = (
        trials.drop("site_id", "second_site_id")
        .join(links, "trial_id")
        .join(placed, "site_id")
        .groupBy(*keys, "trial_id", "variety_norm", "year", "yield_kg_ha", "regime", "production", "derived", "confidence")
        .agg(F.max("weight").alias("w_site"), F.collect_set("name").alias("names"))
    )
    return per_trial.withColumn("w", F.col("w_site") * recency * same)


def rank_varieties(weighted: DataFrame, keys: tuple[str, ...] = (), regime: str | None = None) -> DataFrame:
    """Per variety: weighted mean yield (flat mean if no weight), spread, counts, years, sites and provenance."""
    known = F.col("yield_kg_ha").isNotNull()
    weight = F.sum(F.when(known, F.col("w")))
    mean = F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("yield_kg_ha")), F.nullif(weight, F.lit(0.0))), F.avg("yield_kg_ha"))
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    ranked = weighted.groupBy(*keys, F.col("variety_norm").alias("variety")).agg(
        F.round(mean, 1).alias("mean_yield"),
        F.min("yield_kg_ha").alias("min_yield"),
        F.max("yield_kg_ha").alias("max_yield"),
        F.round(F.stddev_samp("yield_kg_ha"), 1).alias("sd_yield"),
        F.count("yield_kg_ha").alias("numeric_yield_count"),
        F.count(F.lit(1)).alias("trial_count"),
        F.count_if("derived").alias("derived_count"),
        F.sort_array(F.collect_set("year")).alias("years"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("names")))).alias("sites"),
        F.sort_array(F.collect_set("regime")).alias("regimes"),
        F.min_by("confidence", rank).alias("confidence"),
    )
    if regime is not None:
        ranked = ranked.where(F.array_contains("regimes", regime))
    return ranked.withColumn("provenance", A.yield_provenance(F.col("derived_count"), F.col("trial_count")))


def extrapolate(trials: DataFrame, links: DataFrame, sites: DataFrame, crop: str, target: Target, now_year: int, top_n: int | None = 10,
                regime: str | None = None, exclude_sites: list[str] | None = None, site_limit: int = 50) -> DataFrame:
    """Varieties of a crop ranked for a target environment.

    The nearest ``site_limit`` sites are taken first; then trials seen at an excluded site go, with all their links.
    """
    near = similar_sites(sites, target, site_limit).withColumn("weight", F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.col("distance")), F.lit(1.0)))
    rows = usable(trials).where((F.col("crop") == crop) | (F.lower("crop") == crop.lower()))
    if exclude_sites:
        held = sites.where(F.lower("name").isin([s.lower() for s in exclude_sites])).select("site_id")
        rows = rows.join(links.join(held, "site_id", "left_semi").select("trial_id"), "trial_id", "left_anti")
        near = near.where(~F.lower("name").isin([s.lower() for s in exclude_sites]))
    ranked = rank_varieties(trial_weights(rows, links, near, now_year, regime=regime), regime=regime)
    return ranked.orderBy(F.col("mean_yield").desc_nulls_last(), "variety").limit(top_n) if top_n else ranked


def weather_penalties(ranked: DataFrame, weather: DataFrame, keys: list[str]) -> DataFrame:
    """Yields less what drought, heat and frost take; ``weather`` has the figures and the crop's tolerances by key.

    Unknown tolerances mean sensitive; unknown figures trigger nothing.
    """
    part = lambda share, limit, tolerant, cut: F.when((F.col(share) > limit) & ~F.coalesce(tolerant, F.lit(False)), cut).otherwise(0.0)
    total = (
        part("deficit_area_pct", 30, F.col("heat_damage_c") >= 38, 0.2)
        + part("heat_stress_pct", 20, F.col("heat_damage_c") >= 35, 0.15)
        + part("frost_risk_pct", 50, F.col("frost_damage_c") <= -5, 0.25)
    )
    joined = ranked.join(weather, keys, "left").withColumn("penalty", F.round(total, 2))
    cut = F.when(F.col("mean_yield") > 0, F.round(F.col("mean_yield") * (F.lit(1.0) - F.col("penalty")), 1)).otherwise(F.col("mean_yield"))
    return joined.withColumn("adjusted_yield", cut)


def yield_potential(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, deviation and 95 % interval of measured yields by key; a single trial's interval is its yield."""
    known = trials.where("yield_kg_ha IS NOT NULL").select(*keys, "trial_id", "yield_kg_ha").distinct()
    rows = known.groupBy(*keys).agg(F.avg("yield_kg_ha").alias("m"), F.stddev_samp("yield_kg_ha").alias("sd"), F.count(F.lit(1)).alias("n"))
    half = F.coalesce(F.lit(1.96) * F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return rows.select(
        *keys, "n", F.round("m", 1).alias("mean_yield"), F.round("sd", 1).alias("sd_yield"), F.round(F.col("m") - half, 1).alias("ci_low"), F.round(F.col("m") + half, 1).alias("ci_high")
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in the given order, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
