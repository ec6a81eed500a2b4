"""Queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import agronomy as A
from harrow.operators import catalog as C
from harrow.operators import decisions as D
from harrow.operators import hygiene as H
from harrow.operators import rules as R
from harrow.operators import varieties as V
from harrow.operators.backfills import first_per_key
from harrow.plans.backtest import backtest, meets_slo
from harrow.plans.registry import plain, query
from harrow.sources.tables import LINK_SQL, SITE_SQL, TRIAL_SQL, table, trial_links, trial_sites, variety_trials
from harrow.streaming import advisories as S

DOMAIN = f"WITH {SITE_SQL}, {TRIAL_SQL}, {LINK_SQL}"
NOW = 2026
TARGET = V.Target(rainfall=700.0, et0=1000.0, frost=30.0, elevation=500.0, climate_class="EUROPE")
CROP = "STANDARD"


def _domain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    trials = variety_trials(spark, d)
    return trials, trial_links(trials), trial_sites(spark, d)


def _known_places(links: DataFrame, sites: DataFrame) -> DataFrame:
    """Links to sites whose rainfall is known; trials at other sites alone count as orphans in the quality queries."""
    return links.join(sites.where("rainfall IS NOT NULL").select("site_id"), "site_id", "left_semi")


USABLE = "(yield_kg_ha IS NOT NULL OR note IS NOT NULL) AND coalesce(eligible, TRUE)"
VECTORS = """vec AS (
    SELECT *, CASE WHEN rainfall IS NOT NULL AND frost_days IS NOT NULL AND elevation IS NOT NULL AND coalesce(et0, 0) <> 0
                   THEN rainfall / CAST(et0 AS DOUBLE) END AS aridity FROM trial_site)"""
NEAR = f"""{VECTORS},
    b AS (SELECT greatest(max(aridity), 0.7) - least(min(aridity), 0.7) AS sa,
                 greatest(max(CASE WHEN aridity IS NOT NULL THEN rainfall END), 700) - least(min(CASE WHEN aridity IS NOT NULL THEN rainfall END), 700) AS sr,
                 greatest(max(CASE WHEN aridity IS NOT NULL THEN frost_days END), 30) - least(min(CASE WHEN aridity IS NOT NULL THEN frost_days END), 30) AS sf,
                 greatest(max(CASE WHEN aridity IS NOT NULL THEN elevation END), 500) - least(min(CASE WHEN aridity IS NOT NULL THEN elevation END), 500) AS se FROM vec),
    dist AS (SELECT site_id, name, round(CASE WHEN aridity IS NOT NULL THEN sqrt((2 * pow((aridity - 0.7) / sa, 2) + pow((rainfall - 700) / CAST(sr AS DOUBLE), 2)
                 + pow((frost_days - 30) / CAST(sf AS DOUBLE), 2) + 0.5 * pow((elevation - 500) / CAST(se AS DOUBLE), 2)) / 4.5)
                 WHEN climate_class = 'EUROPE' THEN 2.0 END, 4) AS distance FROM vec, b),
    near AS (SELECT * FROM dist WHERE distance IS NOT NULL ORDER BY distance, name, site_id LIMIT 50)"""


@query(f"""{DOMAIN}
    SELECT trial_id, crop, variety, year, yield_kg_ha, regime, site_id, t.name, climate_class FROM (
        SELECT DISTINCT v.trial_id, crop, variety, year, yield_kg_ha, note, regime, production, derived, eligible, source_id, confidence, s.site_id, s.name, s.climate_class
        FROM variety_trial v JOIN trial_at l ON v.trial_id = l.trial_id JOIN trial_site s ON l.site_id = s.site_id
        WHERE {USABLE} AND (crop = '{CROP}' OR contains(lower(variety), 'standard')) AND yield_kg_ha >= 1000 AND climate_class = 'ASIA' AND rainfall BETWEEN 400 AND 900) t
    ORDER BY yield_kg_ha DESC, trial_id, site_id LIMIT 200""")
def variety_trials_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Usable trials under filters, a top-k report."""
    trials, links, sites = _domain(spark, d)
    rows = V.matching(trials, sites, links, crop=CROP, climate_class="ASIA", min_yield=1000.0, rain=(400, 900), limit=200)
    return rows.select("trial_id", "crop", "variety", "year", "yield_kg_ha", "regime", "site_id", "name", "climate_class")


@query(f"WITH {SITE_SQL}, {NEAR} SELECT * FROM near")
def similar_sites_distance(spark: SparkSession, d: str) -> DataFrame:
    """Nearest sites by features."""
    return V.similar_sites(trial_sites(spark, d), TARGET, 50)


@query(f"WITH {SITE_SQL} SELECT site_id, name, CAST(NULL AS DOUBLE) AS distance FROM trial_site WHERE climate_class = 'AFRICA' ORDER BY name, site_id LIMIT 10")
def similar_sites_class(spark: SparkSession, d: str) -> DataFrame:
    """Sites of a class, by name."""
    return V.similar_sites(trial_sites(spark, d), V.Target(climate_class="AFRICA"), 10)


def _extrapolate_sql(held: str = "") -> str:
    hold = f"AND v.trial_id NOT IN (SELECT trial_id FROM trial_at JOIN trial_site USING (site_id) WHERE lower(name) = '{held}')" if held else ""
    away = f"WHERE lower(name) <> '{held}'" if held else ""
    return f"""{DOMAIN}, {NEAR},
    named AS (SELECT name, min(1.0 / (1.0 + distance)) AS weight FROM near {away} GROUP BY name),
    per_trial AS (
        SELECT v.trial_id, variety_norm AS variety, year, yield_kg_ha, regime, production, derived, confidence, max(weight) AS ws
        FROM variety_trial v JOIN trial_at l ON v.trial_id = l.trial_id JOIN near n ON n.site_id = l.site_id JOIN named USING (name)
        WHERE {USABLE} AND crop = '{CROP}' {hold} GROUP BY ALL),
    w AS (SELECT *, ws * CASE WHEN {NOW} - year > 0 THEN pow(0.5, ({NOW} - year) / 8.0) ELSE 1.0 END AS w FROM per_trial),
    site_lists AS (SELECT w.variety, list_sort(list(DISTINCT n.name)) AS sites FROM w JOIN trial_at l ON w.trial_id = l.trial_id JOIN near n ON n.site_id = l.site_id {away.replace('name', 'n.name')} GROUP BY w.variety)
    SELECT variety, round(coalesce(sum(w * yield_kg_ha) / nullif(sum(CASE WHEN yield_kg_ha IS NOT NULL THEN w END), 0), avg(yield_kg_ha)), 1) AS mean_yield,
           min(yield_kg_ha) AS min_yield, max(yield_kg_ha) AS max_yield, round(stddev_samp(yield_kg_ha), 1) AS sd_yield,
           count(yield_kg_ha) AS numeric_yield_count, count(*) AS trial_count, count(*) FILTER (derived) AS derived_count,
           array_to_string(list_sort(list(DISTINCT year)), ',') AS years, len(any_value(sites)) AS n_sites,
           array_to_string(list_sort(list(DISTINCT regime) FILTER (regime IS NOT NULL)), ',') AS regimes,
           CASE min(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
           CASE WHEN count(*) FILTER (derived) = 0 THEN 'measured' WHEN count(*) FILTER (derived) >= count(*) THEN 'derived' ELSE 'partial' END AS provenance
    FROM w JOIN site_lists USING (variety) GROUP BY variety ORDER BY mean_yield DESC NULLS LAST, variety LIMIT 10"""


def _flat(ranked: DataFrame) -> DataFrame:
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return ranked.withColumns({"years": join("years"), "regimes": join("regimes"), "n_sites": F.size("sites").cast("long")}).drop("sites")


@query(_extrapolate_sql())
def extrapolate_varieties(spark: SparkSession, d: str) -> DataFrame:
    """The ten best varieties of a crop for a target environment."""
    trials, links, sites = _domain(spark, d)
    return _flat(V.extrapolate(trials, links, sites, CROP, TARGET, NOW))


@query(_extrapolate_sql("supplier#000000007"))
def extrapolate_holdout(spark: SparkSession, d: str) -> DataFrame:
    """J4 without any trial seen at one site."""
    trials, links, sites = _domain(spark, d)
    return _flat(V.extrapolate(trials, links, sites, CROP, TARGET, NOW, exclude_sites=["supplier#000000007"]))


REFERENCE_SITE = "Supplier#000000001"


@query(f"""{DOMAIN}, {VECTORS}, sp AS (SELECT max(aridity) - min(aridity) AS sa, max(rainfall) - min(rainfall) AS sr, max(frost_days) - min(frost_days) AS sf, max(elevation) - min(elevation) AS se FROM vec WHERE aridity IS NOT NULL),
    t AS (SELECT * FROM vec WHERE lower(name) = lower('{REFERENCE_SITE}')),
    near AS (SELECT s.site_id, s.name, round(CASE WHEN s.aridity IS NULL THEN 2.0 ELSE sqrt((2 * pow((s.aridity - t.aridity) / sa, 2) + pow((s.rainfall - t.rainfall) / CAST(sr AS DOUBLE), 2)
            + pow((s.frost_days - t.frost_days) / CAST(sf AS DOUBLE), 2) + 0.5 * pow((s.elevation - t.elevation) / CAST(se AS DOUBLE), 2)) / 4.5) END, 4) AS distance
        FROM vec s, t, sp WHERE s.aridity IS NOT NULL OR s.climate_class = t.climate_class ORDER BY distance, s.name, s.site_id LIMIT 50),
    per AS (SELECT v.trial_id, variety_norm AS variety, year, yield_kg_ha, regime, production, derived, confidence, max(1.0 / (1.0 + distance)) AS ws
        FROM variety_trial v JOIN trial_at l ON v.trial_id = l.trial_id JOIN near n ON n.site_id = l.site_id WHERE {USABLE} AND crop = '{CROP}' GROUP BY ALL),
    w AS (SELECT *, ws * CASE WHEN {NOW} - year > 0 THEN pow(0.5, ({NOW} - year) / 8.0) ELSE 1.0 END AS w FROM per)
    SELECT variety, round(sum(w * yield_kg_ha) / sum(CASE WHEN yield_kg_ha IS NOT NULL THEN w END), 1) AS mean_yield, count(*) AS trial_count FROM w GROUP BY variety ORDER BY mean_yield DESC NULLS LAST, variety LIMIT 10""")
def extrapolate_reference_site(spark: SparkSession, d: str) -> DataFrame:
    """The best varieties for the environment of a known site."""
    trials, links, sites = _domain(spark, d)
    return V.extrapolate(trials, links, sites, CROP, V.environment_of(sites, REFERENCE_SITE), NOW).select("variety", "mean_yield", "trial_count")


@query(f"""{DOMAIN}, t AS (SELECT DISTINCT trial_id, variety_norm AS variety, note, year, yield_kg_ha FROM variety_trial),
    e AS (SELECT variety, year, trial_id, yield_kg_ha, note, unnest(['note', 'year']) AS name, unnest([CAST(note AS DOUBLE), CAST(year AS DOUBLE)]) AS value FROM t)
    SELECT variety, name, value FROM (SELECT *, row_number() OVER (PARTITION BY variety, name ORDER BY year, trial_id, yield_kg_ha NULLS FIRST, note NULLS FIRST) AS r FROM e WHERE value IS NOT NULL) x WHERE r = 1""")
def first_trait_values(spark: SparkSession, d: str) -> DataFrame:
    """Of each variety's maps of traits the first value of each name, by year and trial."""
    rows = variety_trials(spark, d).select("trial_id", F.col("variety_norm").alias("variety"), "note", "year", "yield_kg_ha").distinct()
    pairs = F.map_filter(F.create_map(F.lit("note"), F.col("note").cast("double"), F.lit("year"), F.col("year").cast("double")), lambda _, v: v.isNotNull())
    return first_per_key(rows.withColumn("traits", pairs), ["variety"], "traits", [F.col("year"), F.col("trial_id"), F.col("yield_kg_ha"), F.col("note")])


@query(f"""{DOMAIN}, need AS (SELECT 'STANDARD' AS crop, 6.0 AS ph_min, 7.5 AS ph_max, 2 AS lo, 3 AS hi UNION ALL SELECT 'SMALL', 5.0, 6.5, 5, 6 UNION ALL SELECT 'LARGE', 5.5, 7.0, 0, 2),
    r AS (SELECT crop, variety_norm AS variety, round(avg(yield_kg_ha), 1) AS mean_yield FROM (SELECT DISTINCT crop, variety_norm, trial_id, yield_kg_ha FROM variety_trial WHERE {USABLE}) t GROUP BY crop, variety_norm),
    c AS (SELECT a.site_id, a.crop, ph_min, ph_max, lo, hi FROM (SELECT site_id, CASE site_id % 4 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'LARGE' ELSE 'PROMO' END AS crop FROM trial_site) a LEFT JOIN need ON need.crop = a.crop),
    g AS (SELECT site_id AS parcel_id, crop, greatest(ph_min - soil_ph, soil_ph - ph_max) AS ph_gap, CASE WHEN o IS NULL OR lo IS NULL THEN NULL ELSE least(abs(o - lo), abs(o - hi)) END AS t_gap
        FROM (SELECT *, CASE soil_texture WHEN 'clay' THEN 6 WHEN 'loam' THEN 3 WHEN 'sandy_loam' THEN 2 WHEN 'Silty-Clay' THEN 5 END AS o FROM trial_site) s JOIN c USING (site_id)),
    v AS (SELECT *, CASE WHEN ph_gap <= 0 THEN 0 WHEN ph_gap <= 0.5 THEN 1 WHEN ph_gap > 0.5 THEN 2 END AS p, CASE WHEN t_gap <= 1 THEN 0 WHEN t_gap <= 3 THEN 1 WHEN t_gap > 3 THEN 2 END AS t FROM g),
    w AS (SELECT parcel_id, crop, CASE greatest(coalesce(p, -1), coalesce(t, -1)) WHEN 0 THEN 'suitable' WHEN 1 THEN 'marginal' WHEN 2 THEN 'unsuitable' ELSE 'unknown' END AS soil_verdict FROM v)
    SELECT parcel_id, w.crop, variety, mean_yield, soil_verdict, soil_verdict = 'unsuitable' AS excluded_by_soil FROM r JOIN w ON w.crop = r.crop""")
def soil_gated_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Rankings of the crop asked for on each parcel, with the varieties that its soil excludes."""
    rows = V.usable(variety_trials(spark, d)).select("crop", F.col("variety_norm").alias("variety"), "trial_id", "yield_kg_ha").distinct()
    ranked = rows.groupBy("crop", "variety").agg(F.round(F.avg("yield_kg_ha"), 1).alias("mean_yield"))
    need = [("STANDARD", 6.0, 7.5, ["sandy loam", "loam"]), ("SMALL", 5.0, 6.5, ["silty clay", "clay"]), ("LARGE", 5.5, 7.0, ["sand", "sandy loam"])]
    tolerance = spark.createDataFrame([(*n, None) for n in need], "crop string, ph_min double, ph_max double, textures array<string>, drainages array<string>")
    sites = trial_sites(spark, d)
    asked = sites.selectExpr("site_id AS parcel_id", "CASE site_id % 4 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'LARGE' ELSE 'PROMO' END AS crop")
    soils = sites.select(F.col("site_id").alias("parcel_id"), F.col("soil_ph").cast("double").alias("ph"), F.col("soil_texture").alias("texture"), F.lit(None).cast("string").alias("drainage"))
    return V.soil_gate(asked, ranked, tolerance, soils).select("parcel_id", "crop", "variety", "mean_yield", "soil_verdict", "excluded_by_soil")


@query(f"""{DOMAIN} SELECT crop, CAST(sum(n) AS BIGINT) AS numeric_yields, CASE WHEN coalesce(sum(n), 0) = 0 THEN 'none' WHEN sum(n) < 5 THEN 'sparse' ELSE 'direct' END AS evidence
    FROM (SELECT crop, variety_norm, count(yield_kg_ha) AS n FROM (SELECT DISTINCT crop, variety_norm, trial_id, yield_kg_ha FROM variety_trial WHERE {USABLE}) t GROUP BY ALL) GROUP BY crop""")
def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """How well each crop's ranking is backed."""
    rows = V.usable(variety_trials(spark, d)).select("crop", "variety_norm", "trial_id", "yield_kg_ha").distinct()
    per = rows.groupBy("crop", "variety_norm").agg(F.count("yield_kg_ha").alias("n")).groupBy("crop").agg(F.sum("n").alias("numeric_yields"))
    return per.withColumn("evidence", A.evidence(F.col("numeric_yields")))


@query(f"""{DOMAIN} SELECT crop, variety_norm, count(*) FILTER (derived) AS derived_count, count(*) AS trial_count,
    CASE WHEN count(*) FILTER (derived) = 0 THEN 'measured' WHEN count(*) FILTER (derived) >= count(*) THEN 'derived' ELSE 'partial' END AS provenance
    FROM (SELECT DISTINCT crop, variety_norm, trial_id, derived FROM variety_trial) t GROUP BY crop, variety_norm""")
def yield_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Whether yields were measured or derived."""
    rows = variety_trials(spark, d).select("crop", "variety_norm", "trial_id", "derived").distinct()
    per = rows.groupBy("crop", "variety_norm").agg(F.count_if("derived").alias("derived_count"), F.count(F.lit(1)).alias("trial_count"))
    return per.withColumn("provenance", A.yield_provenance(F.col("derived_count"), F.col("trial_count")))


WEATHER = {"climate_class": "r_name", "deficit_area_pct": "CAST(10 + r_regionkey * 12 AS DOUBLE)", "heat_stress_pct": "CAST(r_regionkey * 11 AS DOUBLE)",
           "frost_risk_pct": "CAST(30 + r_regionkey * 9 AS DOUBLE)", "heat_damage_c": "CASE WHEN r_regionkey = 4 THEN 39.0 WHEN r_regionkey = 3 THEN NULL ELSE 33.0 + r_regionkey END",
           "frost_damage_c": "CASE WHEN r_regionkey = 4 THEN -7.0 ELSE -2.0 END"}
WEATHER_SQL = "weather AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in WEATHER.items()) + " FROM region)"


@query(f"""{DOMAIN}, {WEATHER_SQL},
    r AS (SELECT climate_class, crop, round(avg(yield_kg_ha), 1) AS mean_yield FROM (SELECT DISTINCT climate_class, crop, v.trial_id, yield_kg_ha FROM variety_trial v JOIN trial_at l ON v.trial_id = l.trial_id JOIN trial_site s ON s.site_id = l.site_id) t GROUP BY ALL),
    p AS (SELECT r.*, round(CASE WHEN deficit_area_pct > 30 AND NOT coalesce(heat_damage_c >= 38, FALSE) THEN 0.2 ELSE 0.0 END
        + CASE WHEN heat_stress_pct > 20 AND NOT coalesce(heat_damage_c >= 35, FALSE) THEN 0.15 ELSE 0.0 END
        + CASE WHEN frost_risk_pct > 50 AND NOT coalesce(frost_damage_c <= -5, FALSE) THEN 0.25 ELSE 0.0 END, 2) AS penalty FROM r LEFT JOIN weather USING (climate_class))
    SELECT climate_class, crop, mean_yield, CAST(penalty AS DOUBLE) AS penalty, round(mean_yield * (1.0 - CAST(penalty AS DOUBLE)), 1) AS adjusted_yield FROM p""")
def weather_penalties(spark: SparkSession, d: str) -> DataFrame:
    """Yields by climate less weather penalties."""
    trials, links, sites = _domain(spark, d)
    rows = trials.drop("site_id").join(links, "trial_id").join(sites, "site_id").select("climate_class", "crop", "trial_id", "yield_kg_ha").distinct()
    ranked = rows.groupBy("climate_class", "crop").agg(F.round(F.avg("yield_kg_ha"), 1).alias("mean_yield"))
    weather = table(spark, d, "region").selectExpr(*(f"{e} AS {c}" for c, e in WEATHER.items()))
    return V.weather_penalties(ranked, weather, ["climate_class"]).select("climate_class", "crop", "mean_yield", "penalty", "adjusted_yield")


@query(f"""{DOMAIN}, t AS (SELECT DISTINCT crop, variety_norm, trial_id, yield_kg_ha FROM variety_trial WHERE yield_kg_ha IS NOT NULL)
    SELECT crop, variety_norm, count(*) AS n, round(avg(yield_kg_ha), 1) AS mean_yield, round(stddev_samp(yield_kg_ha), 1) AS sd_yield,
    round(avg(yield_kg_ha) - coalesce(1.96 * stddev_samp(yield_kg_ha) / sqrt(count(*)), 0), 1) AS ci_low,
    round(avg(yield_kg_ha) + coalesce(1.96 * stddev_samp(yield_kg_ha) / sqrt(count(*)), 0), 1) AS ci_high FROM t GROUP BY crop, variety_norm""")
def yield_potential_ci(spark: SparkSession, d: str) -> DataFrame:
    """Part of J9: mean yield of each variety with its 95 % interval."""
    return V.yield_potential(variety_trials(spark, d), ["crop", "variety_norm"])


@query(f"""{DOMAIN} SELECT s.site_id, s.name, s.climate_class, count(DISTINCT l.trial_id) AS trials, count(DISTINCT v.crop) AS crops
    FROM trial_site s LEFT JOIN trial_at l ON l.site_id = s.site_id LEFT JOIN variety_trial v ON v.trial_id = l.trial_id GROUP BY ALL""")
def trial_sites_summary(spark: SparkSession, d: str) -> DataFrame:
    """What was tried at each site."""
    trials, links, sites = _domain(spark, d)
    return C.site_summary(sites, links, trials)


@query(f"{DOMAIN} SELECT crop, count(DISTINCT variety_norm) AS varieties, count(DISTINCT trial_id) AS trials, min(year) AS first_year, max(year) AS last_year FROM variety_trial GROUP BY crop")
def available_crops(spark: SparkSession, d: str) -> DataFrame:
    """Crops with their varieties, trials and years."""
    return C.available_crops(variety_trials(spark, d))


@query(f"""{DOMAIN} SELECT 'records' AS label, count(*) AS rows_n FROM variety_trial UNION ALL SELECT 'sites', count(*) FROM trial_site UNION ALL SELECT 'links', count(*) FROM trial_at""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of all tables."""
    trials, links, sites = _domain(spark, d)
    return C.table_counts({"records": trials, "sites": sites, "links": links})


@query(f"""{DOMAIN}, ids AS (SELECT trial_id, max(yield_kg_ha) AS y FROM variety_trial GROUP BY trial_id)
    SELECT (SELECT count(*) FROM ids) AS trials, (SELECT count(y) FROM ids) AS with_yield,
      (SELECT count(*) FROM ids WHERE trial_id NOT IN (SELECT trial_id FROM trial_at WHERE site_id IN (SELECT site_id FROM trial_site WHERE rainfall IS NOT NULL))) AS orphans,
      (SELECT count(*) FROM trial_at WHERE site_id IN (SELECT site_id FROM trial_site WHERE rainfall IS NOT NULL)) AS links, (SELECT count(*) FROM trial_site) AS sites, (SELECT count(*) FROM trial_site WHERE climate_class IS NULL) AS unclassified,
      (SELECT count(*) FROM (SELECT 1 FROM trial_site GROUP BY lower(trim(municipality)) HAVING count(*) > 1)) AS repeated_names,
      (SELECT count(DISTINCT source_id) FROM variety_trial) AS sources, (SELECT round(100.0 * count(y) / count(*), 1) FROM ids) AS yield_pct""")
def graph_quality(spark: SparkSession, d: str) -> DataFrame:
    """Completeness of trials, sites and links."""
    trials, links, sites = _domain(spark, d)
    return C.quality(trials, sites, _known_places(links, sites))


@query(f"WITH {SITE_SQL} SELECT DISTINCT climate_class FROM trial_site WHERE climate_class <> ''")
def climate_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes in use."""
    return C.distinct_sorted(trial_sites(spark, d), "climate_class")


@query(f"WITH {SITE_SQL} SELECT DISTINCT soil_type FROM trial_site WHERE soil_type <> ''")
def soil_types(spark: SparkSession, d: str) -> DataFrame:
    """The soil types in use."""
    return C.distinct_sorted(trial_sites(spark, d), "soil_type")


BACKTEST_SQL = f"""{DOMAIN}, {VECTORS},
    sp AS (SELECT max(aridity) - min(aridity) AS sa, max(rainfall) - min(rainfall) AS sr, max(frost_days) - min(frost_days) AS sf, max(elevation) - min(elevation) AS se FROM vec WHERE aridity IS NOT NULL),
    fold AS (SELECT * FROM vec WHERE climate_class IS NOT NULL),
    pairs AS (SELECT a.site_id AS fold_id, a.name AS fold_name, b.site_id, b.name, CASE WHEN a.aridity IS NULL THEN 0.0 WHEN b.aridity IS NULL THEN 2.0
            ELSE round(sqrt((2 * pow((b.aridity - a.aridity) / sa, 2) + pow((b.rainfall - a.rainfall) / CAST(sr AS DOUBLE), 2)
                + pow((b.frost_days - a.frost_days) / CAST(sf AS DOUBLE), 2) + 0.5 * pow((b.elevation - a.elevation) / CAST(se AS DOUBLE), 2)) / 4.5), 4) END AS distance
        FROM fold a, vec b, sp WHERE a.climate_class = b.climate_class OR (a.aridity IS NOT NULL AND b.aridity IS NOT NULL)),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY distance, name, site_id) AS r FROM pairs) t WHERE r <= 50 AND lower(name) <> lower(fold_name)),
    trial AS (SELECT DISTINCT trial_id, crop, variety_norm AS variety, year, yield_kg_ha, derived FROM variety_trial WHERE {USABLE} AND yield_kg_ha IS NOT NULL),
    obs AS (SELECT f.site_id AS fold_id, climate_class, crop, variety, avg(yield_kg_ha) AS observed FROM trial t JOIN trial_at l USING (trial_id) JOIN fold f ON f.site_id = l.site_id WHERE NOT derived GROUP BY ALL),
    pt AS (SELECT fold_id, fold_name, crop, variety, t.trial_id, year, yield_kg_ha, max(1.0 / (1.0 + distance)) AS ws
        FROM trial t JOIN trial_at l ON t.trial_id = l.trial_id JOIN near n ON n.site_id = l.site_id GROUP BY ALL),
    w AS (SELECT *, ws * CASE WHEN {NOW} - year > 0 THEN pow(0.5, ({NOW} - year) / 8.0) ELSE 1.0 END AS w FROM pt
        WHERE NOT EXISTS (SELECT 1 FROM trial_at x JOIN trial_site s ON s.site_id = x.site_id WHERE x.trial_id = pt.trial_id AND lower(s.name) = lower(fold_name))),
    pred AS (SELECT *, row_number() OVER (PARTITION BY fold_id, crop ORDER BY predicted DESC, variety) AS place
        FROM (SELECT fold_id, crop, variety, round(sum(w * yield_kg_ha) / sum(w), 1) AS predicted FROM w GROUP BY ALL) t),
    per AS (SELECT o.*, predicted, place, row_number() OVER (PARTITION BY o.fold_id, o.crop ORDER BY round(observed, 4) DESC, o.variety) AS top
        FROM obs o LEFT JOIN (SELECT * FROM pred WHERE place <= 500) p ON p.fold_id = o.fold_id AND p.crop = o.crop AND p.variety = o.variety),
    folds AS (SELECT fold_id, climate_class, crop, count(CASE WHEN top <= 3 AND place <= 3 THEN 1 END) / CAST(count(CASE WHEN top <= 3 THEN 1 END) AS DOUBLE) AS hit,
        EXISTS (SELECT 1 FROM pred p WHERE p.fold_id = per.fold_id AND p.crop = per.crop) AS covered FROM per GROUP BY fold_id, climate_class, crop),
    shares AS (SELECT crop, climate_class, round(coalesce(avg(CASE WHEN covered THEN hit END), 0.0), 3) AS top3_overlap, round(count(CASE WHEN covered THEN 1 END) / CAST(count(*) AS DOUBLE), 3) AS coverage,
        count(*) AS folds FROM folds GROUP BY GROUPING SETS ((), (crop), (climate_class))),
    errors AS (SELECT crop, climate_class, round(median(abs(predicted - observed)), 1) AS median_abs_error, count(predicted) AS error_pairs FROM per GROUP BY GROUPING SETS ((), (crop), (climate_class))),
    report AS (SELECT s.crop, s.climate_class, median_abs_error, top3_overlap, coverage, folds, error_pairs
        FROM shares s JOIN errors e ON s.crop IS NOT DISTINCT FROM e.crop AND s.climate_class IS NOT DISTINCT FROM e.climate_class)"""


@query(BACKTEST_SQL + " SELECT * FROM report")
def backtest_by_level(spark: SparkSession, d: str) -> DataFrame:
    """Leave-one-site-out accuracy over all, by crop and by climate."""
    trials, links, sites = _domain(spark, d)
    return backtest(trials, links, sites, NOW)


@query(BACKTEST_SQL + """ SELECT *, top3_overlap >= 0.193 AND median_abs_error <= 857.0 AND coverage >= 0.906 AS gate_ok,
    top3_overlap >= 0.25 AND median_abs_error <= 800.0 AND coverage >= 0.90 AS owner_ok FROM report WHERE crop IS NULL AND climate_class IS NULL""")
def backtest_slo(spark: SparkSession, d: str) -> DataFrame:
    """Whether the overall accuracy passes the gate and meets the owner's target."""
    trials, links, sites = _domain(spark, d)
    return meets_slo(backtest(trials, links, sites, NOW))


STAGE_SQL = """stages AS (SELECT DISTINCT p_type AS species, concat('stage', CAST(p_size % 5 AS STRING)) AS stage, CASE WHEN p_size % 5 = 4 THEN NULL ELSE (p_size % 5) * 300 END AS gdd_min,
        CASE WHEN p_size % 5 = 4 THEN NULL ELSE (p_size % 5) * 300 + 300 END AS gdd_max FROM part),
    params AS (SELECT DISTINCT p_type AS species, concat('stage', CAST(p_size % 5 AS STRING)) AS stage, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS cultivar,
        CASE WHEN p_size % 2 = 0 THEN 'irrigated' ELSE 'rainfed' END AS management, p_size % 7 = 0 AS is_default, 0.3 + p_size / 50.0 AS kc FROM part WHERE p_size % 5 <> 3),
    asked AS (SELECT event_id AS query_id, CASE user_id % 6 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LARGE' WHEN 4 THEN 'PROMO' ELSE 'NONE' END AS species,
        CASE WHEN event_id % 3 = 0 THEN concat('STAGE', CAST(user_id % 4 AS STRING)) END AS stage, CASE WHEN event_id % 2 = 0 THEN (event_id * 7) % 1500 END AS gdd,
        CASE WHEN event_id % 4 = 0 THEN 'Brand#11' END AS cultivar, CASE WHEN event_id % 5 < 3 THEN 'irrigated' END AS management FROM events)"""


def _phenology(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    views = f"WITH {STAGE_SQL}"
    return tuple(plain(spark, d, f"{views} SELECT * FROM {name}") for name in ("asked", "stages", "params"))


@query(f"""WITH {STAGE_SQL},
    has AS (SELECT * FROM stages s WHERE EXISTS (SELECT 1 FROM params p WHERE p.species = s.species AND p.stage = s.stage)),
    st AS (SELECT * FROM (SELECT a.*, h.stage AS s_stage, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lower(a.stage) = lower(h.stage) THEN 0 WHEN gdd >= gdd_min AND gdd < gdd_max THEN 1 ELSE 2 END,
        gdd_min ASC NULLS LAST, h.stage) AS r FROM asked a LEFT JOIN has h ON a.species = h.species) t WHERE r = 1),
    pr AS (SELECT st.query_id, s_stage, kc, CASE WHEN p.cultivar = st.cultivar AND p.management = st.management THEN 0 WHEN p.cultivar IS NULL AND p.management = st.management THEN 1 WHEN is_default THEN 2 ELSE 3 END AS priority
        FROM st LEFT JOIN params p ON p.species = st.species AND p.stage = s_stage)
    SELECT query_id, s_stage AS matched_stage, priority, kc FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, kc ASC NULLS LAST) AS r FROM pr) t WHERE r = 1""")
def phenology_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Stage by name or degree days, parameters by precedence."""
    return D.phenology_cascade(*_phenology(spark, d))


@query(f"WITH {STAGE_SQL} SELECT species, stage, CAST(gdd_min AS BIGINT) AS gdd_min, CAST(gdd_max AS BIGINT) AS gdd_max FROM stages WHERE gdd_min IS NOT NULL ORDER BY species, gdd_min")
def phenology_stages(spark: SparkSession, d: str) -> DataFrame:
    """Stages with degree days, in order."""
    stages = _phenology(spark, d)[1].where("gdd_min IS NOT NULL").orderBy("species", "gdd_min")
    return stages.withColumns({c: F.col(c).cast("long") for c in ("gdd_min", "gdd_max")})


@query(f"""WITH {SITE_SQL}, need AS (SELECT 'wheat' AS crop, 6.0 AS ph_min, 7.5 AS ph_max, 2 AS lo, 3 AS hi UNION ALL SELECT 'rice', 5.0, 6.5, 5, 6 UNION ALL SELECT 'carrot', 5.5, 7.0, 0, 2),
    g AS (SELECT site_id, crop, greatest(ph_min - soil_ph, soil_ph - ph_max) AS ph_gap,
        CASE WHEN o IS NULL THEN NULL ELSE least(abs(o - lo), abs(o - hi)) END AS t_gap FROM (SELECT *, CASE soil_texture WHEN 'clay' THEN 6 WHEN 'loam' THEN 3 WHEN 'sandy_loam' THEN 2 WHEN 'Silty-Clay' THEN 5 END AS o FROM trial_site) s, need),
    v AS (SELECT *, CASE WHEN ph_gap <= 0 THEN 0 WHEN ph_gap <= 0.5 THEN 1 WHEN ph_gap > 0.5 THEN 2 END AS p, CASE WHEN t_gap <= 1 THEN 0 WHEN t_gap <= 3 THEN 1 WHEN t_gap > 3 THEN 2 END AS t FROM g)
    SELECT site_id, crop, CASE greatest(coalesce(p, -1), coalesce(t, -1)) WHEN 0 THEN 'suitable' WHEN 1 THEN 'marginal' WHEN 2 THEN 'unsuitable' ELSE 'unknown' END AS verdict,
        CASE WHEN p IS NOT NULL AND t IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM v""")
def soil_suitability(spark: SparkSession, d: str) -> DataFrame:
    """Every site's soil against the needs of three crops."""
    needs = spark.createDataFrame(
        [("wheat", 6.0, 7.5, ["sandy loam", "loam"]), ("rice", 5.0, 6.5, ["silty clay", "clay"]), ("carrot", 5.5, 7.0, ["sand", "sandy loam"])],
        "crop string, ph_min double, ph_max double, textures array<string>",
    ).withColumn("k", F.lit(1))
    rows = trial_sites(spark, d).withColumn("k", F.lit(1)).join(needs, "k")  # three reference rows: the result itself
    none = F.lit(None).cast("string")
    v = A.soil_verdict(F.col("soil_ph").cast("double"), F.col("ph_min"), F.col("ph_max"), F.col("soil_texture"), F.col("textures"), none, F.array().cast("array<string>"))
    return rows.select("site_id", "crop", v["verdict"].alias("verdict"), v["confidence"].alias("confidence"))


@query("""WITH crops AS (SELECT DISTINCT p_type AS crop FROM part), rules AS (SELECT a.crop AS crop_a, b.crop AS crop_b, CASE (length(a.crop) + length(b.crop)) % 3 WHEN 0 THEN 'benefit' WHEN 1 THEN NULL ELSE 'restriction' END AS effect FROM crops a, crops b WHERE a.crop < b.crop)
    SELECT a.crop AS previous, b.crop AS candidate FROM crops a, crops b WHERE a.crop <> b.crop AND NOT EXISTS (SELECT 1 FROM rules WHERE crop_a = a.crop AND crop_b = b.crop AND coalesce(effect, 'restriction') = 'restriction')""")
def rotation_next_crop(spark: SparkSession, d: str) -> DataFrame:
    """Crops that may follow each crop."""
    crops = table(spark, d, "part").select(F.col("p_type").alias("crop")).distinct()
    kind = (F.length("crop_a") + F.length("crop_b")) % 3
    pairs = crops.select(F.col("crop").alias("crop_a"), F.lit(1).alias("k")).join(crops.select(F.col("crop").alias("crop_b"), F.lit(1).alias("k")), "k").where("crop_a < crop_b")
    return D.next_crops(crops, pairs.withColumn("effect", F.when(kind == 0, "benefit").when(kind == 2, "restriction")))


@query("""WITH soil AS (SELECT p_partkey AS parcel_id, p_type AS crop, e AS element, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size * k END AS available FROM part, (SELECT 'N' AS e, 2.0 AS k UNION ALL SELECT 'P', 0.5 UNION ALL SELECT 'K', 1.5) x),
    uptake AS (SELECT DISTINCT p_type AS crop, e AS element, length(p_type) * k AS uptake FROM part, (SELECT 'N' AS e, 8.0 AS k UNION ALL SELECT 'P', 2.0 UNION ALL SELECT 'K', 6.0) x)
    SELECT parcel_id, crop, element, CASE WHEN available IS NULL THEN 'unknown' WHEN available < uptake * 0.5 THEN 'deficient' WHEN available < uptake THEN 'adequate' ELSE 'sufficient' END AS status,
        CAST(round(CASE WHEN uptake - available > 0 THEN uptake - available WHEN available IS NULL THEN 0.0 ELSE 0.0 END, 2) AS DOUBLE) AS gap FROM soil JOIN uptake USING (crop, element)""")
def fertilizer_need(spark: SparkSession, d: str) -> DataFrame:
    """Nutrient status of parcels."""
    part = table(spark, d, "part")
    rates = lambda n, p, k: F.explode(F.create_map(F.lit("N"), F.lit(n), F.lit("P"), F.lit(p), F.lit("K"), F.lit(k))).alias("element", "k")
    soil = part.select(F.col("p_partkey").alias("parcel_id"), F.col("p_type").alias("crop"), "p_size", rates(2.0, 0.5, 1.5))
    soil = soil.withColumn("available", F.when(F.col("parcel_id") % 17 != 0, F.col("p_size") * F.col("k"))).drop("k", "p_size")
    uptake = part.select(F.col("p_type").alias("crop")).distinct().select("crop", rates(8.0, 2.0, 6.0)).select("crop", "element", (F.length("crop") * F.col("k")).alias("uptake"))
    rows = D.fertilizer_need(soil, uptake)
    return rows.select("parcel_id", "crop", "element", "status", F.coalesce("gap", F.lit(0.0)).alias("gap"))


@query("""WITH sp AS (SELECT DISTINCT p_type AS species, CAST(length(p_type) - 3 AS DOUBLE) AS base_temp, 1 + (length(p_type) * 5) % 12 AS sow, 1 + (length(p_type) * 5 + 4) % 12 AS ant FROM part),
    cl AS (SELECT r_name AS climate, r_regionkey AS k FROM region), m AS (SELECT unnest(range(0, 12)) AS step),
    g AS (SELECT species, climate, base_temp, k, step, (ant - sow + 12) % 12 AS span, (sow - 1 + step) % 12 + 1 AS month FROM sp, cl, m WHERE step <= (ant - sow + 12) % 12)
    SELECT species, climate, round(sum(greatest(0, (5 + k * 3 + 10 - abs(month - 7) * 2) - base_temp) * CASE WHEN step = 0 OR step = span THEN 15 ELSE [31,28,31,30,31,30,31,31,30,31,30,31][month] END), 0) AS gdd FROM g GROUP BY species, climate""")
def gdd_normals(spark: SparkSession, d: str) -> DataFrame:
    """Degree days from sowing to anthesis by species and climate."""
    n = F.length("species")
    species = table(spark, d, "part").select(F.col("p_type").alias("species")).distinct().select(
        "species", (n - 3).cast("double").alias("base_temp"), (F.lit(1) + (n * 5) % 12).alias("sow_month"), (F.lit(1) + (n * 5 + 4) % 12).alias("anthesis_month")
    )
    temps = F.array(*(F.lit(15.0 - abs(m - 7) * 2) + F.col("r_regionkey") * 3 for m in range(1, 13)))
    climates = table(spark, d, "region").select(F.col("r_name").alias("climate"), temps.alias("temps"))
    return D.gdd_from_normals(species, climates)


@query("""WITH c AS (SELECT s_suppkey AS site_id, CAST((s_suppkey * 7) % 30 - 2 AS DOUBLE) AS t, CAST((s_suppkey * 91) % 2400 AS DOUBLE) AS r, CAST((s_suppkey * 7) % 30 - 12 AS DOUBLE) AS lo, CAST((s_suppkey * 7) % 30 + 9 AS DOUBLE) AS hi,
        CAST((s_suppkey * 13) % 90 AS DOUBLE) AS d, CASE WHEN s_suppkey % 2 = 0 THEN 'winter' ELSE 'summer' END AS w FROM supplier)
    SELECT site_id, CASE WHEN hi < 10 THEN CASE WHEN lo > 0 THEN 'ET' ELSE 'EF' END
        WHEN r < 20 * (t + 7) THEN CASE WHEN r < 10 * (t + 7) THEN CASE WHEN t >= 18 THEN 'BWh' ELSE 'BWk' END ELSE CASE WHEN t >= 18 THEN 'BSh' ELSE 'BSk' END END
        WHEN lo >= 18 THEN CASE WHEN d >= 60 THEN 'Af' WHEN r >= 25 * (100 - d) THEN 'Am' ELSE 'Aw' END
        WHEN lo >= -3 THEN CASE WHEN hi >= 22 THEN CASE WHEN w = 'winter' THEN 'Csa' WHEN d < 30 THEN 'Cwa' ELSE 'Cfa' END ELSE CASE WHEN w = 'winter' THEN 'Csb' ELSE 'Cfb' END END
        WHEN hi >= 22 THEN CASE WHEN w = 'winter' THEN 'Dwa' ELSE 'Dfa' END WHEN hi >= 10 THEN CASE WHEN w = 'winter' THEN 'Dwb' ELSE 'Dfb' END ELSE 'Dfc' END AS koppen FROM c""")
def koppen_class(spark: SparkSession, d: str) -> DataFrame:
    """Climate class from annual and seasonal figures."""
    k = F.col("s_suppkey")
    num = lambda c: c.cast("double")
    t = num(k * 7 % 30)
    return table(spark, d, "supplier").select(
        k.alias("site_id"), A.koppen(t - 2, num(k * 91 % 2400), t - 12, t + 9, num(k * 13 % 90), F.when(k % 2 == 0, "winter").otherwise("summer")).alias("koppen")
    )


@query(f"""WITH {SITE_SQL}, x AS (SELECT site_id, -tan(radians(latitude)) * tan(0.006918 - 0.399912 * cos(b) + 0.070257 * sin(b) - 0.006758 * cos(2 * b) + 0.000907 * sin(2 * b) - 0.002697 * cos(3 * b) + 0.00148 * sin(3 * b)) AS x
        FROM trial_site, (SELECT 2 * pi() / 365 * 171 AS b) t)
    SELECT site_id, CASE WHEN x >= 1 THEN 0.0 WHEN x <= -1 THEN 24.0 ELSE round(24 * acos(x) / pi(), 2) END AS hours FROM x""")
def photoperiod(spark: SparkSession, d: str) -> DataFrame:
    """Day length at the summer solstice."""
    return trial_sites(spark, d).select("site_id", A.photoperiod_hours(F.col("latitude")).alias("hours"))


@query("""WITH i AS (SELECT p_partkey AS parcel_id, (10 + p_size) / 100.0 AS s, (5 + p_partkey % 40) / 100.0 AS c, (0.5 + p_size % 4) / 100.0 AS o FROM part),
    a AS (SELECT *, -0.024 * s + 0.487 * c + 0.006 * o + 0.005 * s * o - 0.013 * c * o + 0.068 * s * c + 0.031 AS w, -0.251 * s + 0.195 * c + 0.011 * o + 0.006 * s * o - 0.027 * c * o + 0.452 * s * c + 0.299 AS f,
        0.278 * s + 0.034 * c + 0.022 * o - 0.018 * s * o - 0.027 * c * o - 0.584 * s * c + 0.078 AS e FROM i),
    b AS (SELECT *, w + 0.14 * w - 0.02 AS wp, f + 1.283 * f * f - 0.374 * f - 0.015 AS fc FROM a),
    z AS (SELECT *, fc + e + 0.636 * e - 0.107 - 0.097 * s + 0.043 AS st FROM b)
    SELECT parcel_id, round(CAST(wp AS DOUBLE), 3) AS theta_wp, round(CAST(fc AS DOUBLE), 3) AS theta_fc, round(CAST(st AS DOUBLE), 3) AS theta_sat, round(greatest(0.01, CAST(fc - wp AS DOUBLE)) * 1000, 1) AS awc_mm_m,
        CASE WHEN st > fc THEN round(46320.0 * pow(st - fc, 3.0 - (ln(fc) - ln(wp)) / (ln(1500.0) - ln(33.0))), 1) END AS k_sat_mm_d FROM z""".replace("/ 100.0", "/ CAST(100 AS DOUBLE)"))
def pedotransfer(spark: SparkSession, d: str) -> DataFrame:
    """Soil water of parcels from texture and organic matter."""
    p = A.saxton_rawls((F.col("p_size") + 10).cast("double"), (F.col("p_partkey") % 40 + 5).cast("double"), (F.col("p_size") % 4 + 0.5).cast("double"))
    digits = {"awc_mm_m": 1, "k_sat_mm_d": 1}
    return table(spark, d, "part").select(F.col("p_partkey").alias("parcel_id"), *(F.round(c, digits.get(n, 3)).alias(n) for n, c in p.items()))


COVER = {"crop": "concat(p_brand, '-', CAST(p_size AS STRING))", "biomass_t_ha": "CAST(p_size % 9 AS DOUBLE)", "c_n_ratio": "CASE WHEN p_size % 8 = 0 THEN NULL ELSE CAST(8 + p_size % 20 AS DOUBLE) END",
         "frost_tolerance_c": "CAST(-(p_size % 12) AS DOUBLE)", "source_management": "CASE p_size % 3 WHEN 0 THEN 'organic' WHEN 1 THEN 'conventional' ELSE 'unspecified' END", "frost_days": "p_size % 4"}


@query("WITH c AS (SELECT DISTINCT " + ", ".join(f"{e} AS {c}" for c, e in COVER.items()) + """ FROM part), b AS (SELECT *, CASE WHEN source_management <> 'organic' THEN biomass_t_ha * CAST(0.8 AS DOUBLE) ELSE biomass_t_ha END AS bio FROM c)
    SELECT crop, round(bio, 1) AS target_biomass, NOT (bio < 2.0 OR coalesce(c_n_ratio > 20, FALSE) OR (frost_days > 0 AND frost_tolerance_c > -5)) AS suitable FROM b""")
def cover_crop_rank(spark: SparkSession, d: str) -> DataFrame:
    """Cover crops under organic farming."""
    crops = table(spark, d, "part").selectExpr(*(f"{e} AS {c}" for c, e in COVER.items())).distinct()
    return D.cover_crops(crops, "organic").select("crop", "target_biomass", "suitable").orderBy(F.desc("suitable"), F.desc("target_biomass"), "crop")


@query(f"""{DOMAIN}, g AS (SELECT crop, climate_class, production AS management, round(avg(yield_kg_ha), 1) AS mean_yield, min(yield_kg_ha) AS min_yield, max(yield_kg_ha) AS max_yield, count(*) AS n
        FROM variety_trial v JOIN trial_site s ON s.site_id = v.site_id WHERE yield_kg_ha > 0 AND confidence <> 'low' GROUP BY ALL)
    SELECT crop, climate_class, management, mean_yield, min_yield, max_yield, n, round(mean_yield / (0.45 * 1000), 2) AS biomass_t_ha, n >= 3 AS overrides
    FROM (SELECT *, row_number() OVER (PARTITION BY crop, climate_class ORDER BY n DESC, management) AS r FROM g) t WHERE r = 1""")
def scraped_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of observations under the management with most records."""
    rows = variety_trials(spark, d).join(trial_sites(spark, d).select("site_id", "climate_class"), "site_id")
    return D.observed_stats(rows.withColumn("management", F.col("production")).withColumn("is_guide", F.col("confidence") == "low"))


@query(f"""{DOMAIN}, m AS (SELECT crop, climate_class, round(avg(yield_kg_ha), 1) AS yield_mean, round(max(yield_kg_ha), 1) AS yield_top, CAST(count(*) AS DOUBLE) AS n FROM variety_trial v JOIN trial_site s ON s.site_id = v.site_id WHERE {USABLE} GROUP BY ALL)
    SELECT crop, climate_class, round(CAST(100.0 * 40 / 90 AS DOUBLE) * yield_mean / max(yield_mean) OVER w + CAST(100.0 * 30 / 90 AS DOUBLE) * yield_top / max(yield_top) OVER w + CAST(100.0 * 20 / 90 AS DOUBLE) * n / max(n) OVER w, 1) AS score
    FROM m WINDOW w AS (PARTITION BY climate_class)""")
def suggest_crops(spark: SparkSession, d: str) -> DataFrame:
    """Part of J44, J45: crops of each climate by mean yield, highest yield and records, relative to the best."""
    rows = V.usable(variety_trials(spark, d)).join(trial_sites(spark, d).select("site_id", "climate_class"), "site_id")
    facts = rows.groupBy("crop", "climate_class").agg(
        F.round(F.avg("yield_kg_ha"), 1).alias("yield_mean"), F.round(F.max("yield_kg_ha"), 1).alias("yield_top"), F.count(F.lit(1)).cast("double").alias("n")
    )
    return D.composite_scores(facts, ["climate_class"], {"yield_mean": 40, "yield_top": 30, "n": 20}).select("crop", "climate_class", "score")


ROTATION_SQL = """crops AS (SELECT DISTINCT p_type AS crop FROM part), sc AS (SELECT a.crop AS previous, b.crop, (length(a.crop) * 7 + length(b.crop) * 13 + ascii(b.crop)) % 50 AS score FROM crops a, crops b WHERE a.crop <> b.crop),
    rk AS (SELECT *, row_number() OVER (PARTITION BY previous ORDER BY score DESC, crop) AS r FROM sc), parcels AS (SELECT s_suppkey AS parcel_id, t.crop AS previous FROM supplier, (SELECT crop, row_number() OVER (ORDER BY crop) AS i FROM crops) t WHERE i = 1 + s_suppkey % 6)"""


def _rotation(spark: SparkSession, d: str, years: int) -> DataFrame:
    scores = plain(spark, d, f"WITH {ROTATION_SQL} SELECT previous, crop, score FROM sc")
    return D.optimise_rotation(plain(spark, d, f"WITH {ROTATION_SQL} SELECT * FROM parcels"), scores, years)


@query(f"""WITH RECURSIVE {ROTATION_SQL}, plan AS (SELECT parcel_id, 1 AS year_no, k.crop, k.score, k.previous FROM parcels p JOIN rk k ON k.previous = p.previous AND k.r = 1
        UNION ALL SELECT parcel_id, year_no + 1, k.crop, k.score, k.previous FROM plan p JOIN rk k ON k.previous = p.crop AND k.r = 1 WHERE year_no < 4)
    SELECT p.parcel_id, p.year_no, p.crop, p.score, (SELECT string_agg(k.crop, ',' ORDER BY k.r) FROM rk k WHERE k.previous = p.previous AND k.r BETWEEN 2 AND 4) AS alternatives FROM plan p""")
def rotation_optimise(spark: SparkSession, d: str) -> DataFrame:
    """Part of J47: four years of the allowed successor with the best given score, with alternatives."""
    return _rotation(spark, d, 4).withColumn("alternatives", F.array_join("alternatives", ","))


@query(f"""WITH RECURSIVE {ROTATION_SQL}, plan AS (SELECT parcel_id, 1 AS year_no, k.crop FROM parcels p JOIN rk k ON k.previous = p.previous AND k.r = 1
        UNION ALL SELECT parcel_id, year_no + 1, k.crop FROM plan p JOIN rk k ON k.previous = p.crop AND k.r = 1 WHERE year_no < 4),
    n AS (SELECT *, CASE WHEN length(crop) = 5 THEN 60.0 ELSE 10.0 END AS fixed, length(crop) * 5.0 AS required FROM plan),
    pool AS (SELECT parcel_id, year_no, greatest(0, fixed - required) AS soil_n FROM n WHERE year_no = 1
        UNION ALL SELECT n.parcel_id, n.year_no, greatest(0, soil_n + fixed - required) FROM pool JOIN n ON n.parcel_id = pool.parcel_id AND n.year_no = pool.year_no + 1)
    SELECT parcel_id, year_no, CAST(soil_n AS DOUBLE) AS soil_n FROM pool""")
def nitrogen_balance(spark: SparkSession, d: str) -> DataFrame:
    """E13 and part of J46: the clamped nitrogen pool over a rotation."""
    plan = _rotation(spark, d, 4)
    n = F.length("crop")
    return D.nitrogen_balance(plan.select("parcel_id", "year_no", F.when(n == 5, 60.0).otherwise(10.0).alias("fixed"), (n * 5.0).alias("required")))


@query(f"""WITH RECURSIVE {ROTATION_SQL}, plan AS (SELECT parcel_id, 1 AS year_no, k.crop FROM parcels p JOIN rk k ON k.previous = p.previous AND k.r = 1
        UNION ALL SELECT parcel_id, year_no + 1, k.crop FROM plan p JOIN rk k ON k.previous = p.crop AND k.r = 1 WHERE year_no < 4),
    c AS (SELECT parcel_id, CASE WHEN count(DISTINCT crop) >= 3 THEN 20 WHEN count(DISTINCT crop) = 2 THEN 10 ELSE 0 END AS diversity, CASE WHEN bool_or(crop = 'PROMO') THEN 20 ELSE 0 END AS legumes,
        CASE WHEN bool_or(crop = 'SMALL') THEN 25 ELSE 0 END AS cover, CASE WHEN parcel_id % 20 < 10 THEN 20 ELSE 0 END AS erosion FROM plan GROUP BY parcel_id)
    SELECT *, diversity + legumes + cover + erosion AS score_pct FROM c""")
def rotation_compliance(spark: SparkSession, d: str) -> DataFrame:
    """Points of a rotation by rules."""
    plan = _rotation(spark, d, 4)
    return D.compliance(plan.select("parcel_id", "crop", (F.col("crop") == "PROMO").alias("legume"), (F.col("crop") == "SMALL").alias("cover"), (F.col("parcel_id") % 20).alias("slope_pct")))


@query(f"""WITH {SITE_SQL}, i AS (SELECT site_id, CASE WHEN site_id % 3 = 0 THEN NULL ELSE 0.3 + (site_id % 10) / CAST(10 AS DOUBLE) END AS kc, CASE WHEN site_id % 4 = 0 THEN NULL ELSE CAST(80 + site_id % 90 AS DOUBLE) END AS awc,
        CASE WHEN site_id % 5 = 0 THEN 0.0 ELSE CAST(site_id % 100 AS DOUBLE) END AS m, CASE WHEN site_id % 7 = 0 THEN NULL ELSE CAST(et0 / 26 AS INT) + 0.0 END AS e FROM trial_site),
    c AS (SELECT site_id, coalesce(kc, CAST(0.85 AS DOUBLE)) AS kc, coalesce(awc, 120) AS awc, coalesce(nullif(m, 0), 70) AS m, coalesce(e, 35) AS e FROM i),
    r AS (SELECT site_id, round(kc * e, 2) AS etc_mm, awc * m / 100 - awc * 0.5 AS free FROM c),
    d AS (SELECT site_id, etc_mm, greatest(0, round(etc_mm - 5 - greatest(0, free), 2)) AS deficit_mm FROM r)
    SELECT site_id, etc_mm, deficit_mm, CASE WHEN deficit_mm <= 0 THEN 'none' WHEN deficit_mm < 15 THEN 'light' WHEN deficit_mm < 30 THEN 'apply' ELSE 'urgent' END AS recommendation FROM d""".replace("CAST(et0 / 26 AS INT)", "floor(et0 / CAST(26 AS DOUBLE))"))
def water_budget(spark: SparkSession, d: str) -> DataFrame:
    """Weekly irrigation need."""
    k = F.col("site_id")
    b = A.water_budget(
        F.when(k % 3 != 0, F.lit(0.3) + (k % 10) / F.lit(10.0)), F.when(k % 4 != 0, (k % 90 + 80).cast("double")),
        F.when(k % 5 == 0, 0.0).otherwise((k % 100).cast("double")), F.when(k % 7 != 0, F.floor(F.col("et0") / F.lit(26.0)).cast("double")), F.lit(None).cast("double"),
    )
    return trial_sites(spark, d).select("site_id", *(c.alias(n) for n, c in b.items()))


@query(f"""WITH {SITE_SQL}, c AS (SELECT site_id, coalesce(nullif(CAST(et0 AS DOUBLE), 0), rainfall * CAST(0.8 AS DOUBLE)) * 0.4 * 0.8 - (CAST(rainfall AS DOUBLE) * 0.6 * 0.8 + 60) AS x, rainfall FROM trial_site)
    SELECT site_id, round(x, 1) AS deficit_mm, CASE WHEN rainfall IS NULL THEN 'unknown' WHEN x < -20 THEN 'low' WHEN x < 20 THEN 'medium' ELSE 'high' END AS risk FROM c""")
def water_balance_risk(spark: SparkSession, d: str) -> DataFrame:
    """Seasonal water risk of a cover crop."""
    r = A.water_risk(F.col("rainfall").cast("double"), F.col("et0").cast("double"), F.lit(None).cast("double"))
    return trial_sites(spark, d).select("site_id", *(c.alias(n) for n, c in r.items()))


@query("""WITH i AS (SELECT p_partkey AS parcel_id, CAST(p_size % 12 AS DOUBLE) AS b, CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_partkey % 30) / CAST(10 AS DOUBLE) END AS soc FROM part),
    g AS (SELECT *, round(b * CAST(0.45 AS DOUBLE) * CAST(0.15 AS DOUBLE) / 10, 2) AS gain FROM i)
    SELECT parcel_id, gain AS soc_delta_pct, round(b * CAST(0.45 AS DOUBLE) * CAST(3.67 AS DOUBLE), 1) AS co2e_t_ha, CASE WHEN soc < 2.5 AND gain > 0 THEN CAST(greatest(1, round_even((2.5 - soc) / gain, 0)) AS INT) END AS years_to_target FROM g""")
def carbon_projection(spark: SparkSession, d: str) -> DataFrame:
    """Carbon gains and years to a target."""
    soc = F.when(F.col("p_size") % 5 != 0, (F.col("p_partkey") % 30) / F.lit(10.0))
    c = A.carbon((F.col("p_size") % 12).cast("double"), soc, F.lit(2.5))
    return table(spark, d, "part").select(F.col("p_partkey").alias("parcel_id"), *(v.alias(n) for n, v in c.items()))


@query("""WITH st AS (SELECT s_suppkey AS parcel_id, i AS stage_no, 0.2 + ((s_suppkey + i * 3) % 12) / CAST(10 AS DOUBLE) AS ky, 1 + s_suppkey % 4 AS cur FROM supplier, (SELECT unnest(range(1, 5)) AS i) t)
    SELECT parcel_id, round(product(greatest(0.3, least(1.0, 1 - ky * (1 - CAST(0.85 AS DOUBLE))))), 4) AS factor FROM st WHERE stage_no >= cur GROUP BY parcel_id""")
def yield_projection(spark: SparkSession, d: str) -> DataFrame:
    """Yield factor over the stages to come."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("parcel_id"), (k % 4 + 1).alias("current_stage"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("stage_no"))
    return D.yield_projection(rows.withColumn("ky", F.lit(0.2) + ((F.col("parcel_id") + F.col("stage_no") * 3) % 12) / F.lit(10.0)))


SEASON_SQL = """w AS (SELECT s_suppkey AS parcel_id, d AS day, CAST((s_suppkey + d * 3) % 12 AS DOUBLE) AS tmin, CAST(14 + (s_suppkey * 5 + d) % 18 AS DOUBLE) AS tmax, CASE WHEN (s_suppkey + d) % 6 = 0 THEN CAST(d % 25 AS DOUBLE) ELSE 0.0 END AS precip,
    CASE WHEN d % 9 = 0 THEN NULL ELSE CAST(2 + (s_suppkey + d) % 5 AS DOUBLE) END AS eto FROM supplier, days)"""


@query(f"""WITH RECURSIVE days AS (SELECT unnest(range(1, 201)) AS d), {SEASON_SQL},
    sim AS (SELECT s_suppkey AS parcel_id, 0 AS day, CAST(0 AS DOUBLE) AS gdd, CAST(98 AS DOUBLE) AS water, CAST(1 AS DOUBLE) AS stress, 0 AS days, FALSE AS done FROM supplier
        UNION ALL SELECT parcel_id, day, g, CASE WHEN done THEN water0 ELSE wt END, CASE WHEN done THEN stress0 WHEN wt / 140 < 0.5 THEN stress0 * greatest(0.3, least(1.0, 1 - ky * (1 - wt / 140 / 0.5))) ELSE stress0 END, CASE WHEN done THEN days0 ELSE days0 + 1 END, done
        FROM (SELECT *, greatest(0, least(140, water0 + precip - kc * coalesce(eto, 3.5))) AS wt FROM (SELECT *, CASE WHEN g >= 1640 THEN 0.4 WHEN g >= 1100 THEN 1.15 WHEN g >= 220 THEN 0.7 ELSE 0.35 END AS kc,
            CASE WHEN g >= 1640 THEN 0.4 WHEN g >= 1100 THEN 0.65 WHEN g >= 220 THEN 0.55 ELSE 0.4 END AS ky, done0 OR g >= 2000 AS done
            FROM (SELECT s.parcel_id, w.day, CASE WHEN s.done THEN s.gdd ELSE s.gdd + greatest(0, (tmin + tmax) / 2) END AS g, s.water AS water0, s.stress AS stress0, s.days AS days0, s.done AS done0, precip, eto FROM sim s JOIN w ON w.parcel_id = s.parcel_id AND w.day = s.day + 1) a) b) c)
    SELECT parcel_id, days, round(gdd, 1) AS gdd, round(stress, 3) AS stress FROM sim WHERE day = 200""")
def season_simulation(spark: SparkSession, d: str) -> DataFrame:
    """Daily soil water and yield stress of a season."""
    return D.season_simulation(plain(spark, d, f"WITH days AS (SELECT explode(sequence(1, 200)) AS d), {SEASON_SQL} SELECT * FROM w"))


@query("""WITH p AS (SELECT DISTINCT p_brand AS crop, p_name AS pest FROM part), j AS (SELECT a.crop AS crop_a, b.crop AS crop_b, a.pest FROM p a JOIN p b ON a.pest = b.pest AND a.crop < b.crop)
    SELECT crop_a, crop_b, array_to_string(list_sort(list(pest))[1:10], ',') AS shared, count(*) AS n, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS risk FROM j GROUP BY crop_a, crop_b""")
def shared_pests(spark: SparkSession, d: str) -> DataFrame:
    """Pests that two crops share."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("crop"), F.col("p_name").alias("pest"))
    return D.shared_pests(p, p).withColumn("shared", F.array_join("shared", ",")).withColumn("n", F.col("n").cast("long"))


EVENT = {"parcel_id": "user_id", "kind": "CASE WHEN event_type IN ('error', 'click') THEN 'alert' ELSE 'status' END", "stage": "CASE WHEN event_type IN ('view', 'signup', 'purchase') THEN event_type END"}


@query("WITH e AS (SELECT event_id, ts, value, " + ", ".join(f"{e} AS {c}" for c, e in EVENT.items()) + """ FROM events)
    SELECT event_id, parcel_id, carried_stage FROM (SELECT *, last_value(stage IGNORE NULLS) OVER (PARTITION BY parcel_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried_stage FROM e) t
    WHERE kind = 'alert' AND ts >= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def alerts_recent(spark: SparkSession, d: str) -> DataFrame:
    """The newest alerts with the stage that their parcel had; a top-k report."""
    events = table(spark, d, "events").selectExpr("event_id", "ts", "value", *(f"{e} AS {c}" for c, e in EVENT.items()))
    return S.recent_alerts(events, "2024-01-15 00:00:00", 100).select("event_id", "parcel_id", "carried_stage")


RULES = [
    {"id": "irrigate", "priority": 2, "conditions": {"all": [{"field": "value", "op": "gte", "value": 50.0}, {"field": "stage", "op": "in", "value": ["view", "click"]}]},
     "action": {"urgency": "high", "description_template": "Irrigate at {stage}: {level}"}},
    {"id": "terminate", "priority": 1, "species_links": ["purchase"], "conditions": {"all": [{"field": "parcel_id", "op": "lt", "value": 75}]}, "action": {"description_template": "Terminate {stage}"}},
    {"id": "never", "conditions": {"all": [{"field": "missing", "op": "nin", "value": ["x"]}]}, "action": {}},
    {"id": "off", "active": False, "conditions": {"all": []}, "action": {}},
]


@query("""WITH e AS (SELECT event_id, user_id AS parcel_id, event_type AS stage, value FROM events)
    SELECT event_id, 'irrigate' AS rule_id, 2 AS priority, 'high' AS urgency FROM e WHERE value >= 50.0 AND stage IN ('view', 'click')
    UNION ALL SELECT event_id, 'terminate', 1, NULL FROM e WHERE parcel_id < 75 AND stage = 'purchase'""")
def action_rule_match(spark: SparkSession, d: str) -> DataFrame:
    """Rules that hold for each observation."""
    e = table(spark, d, "events").selectExpr("event_id", "user_id AS parcel_id", "event_type AS stage", "event_type AS species", "value")
    return R.match_rules(e, RULES).select("event_id", "rule_id", "priority", "urgency")


@query("""WITH e AS (SELECT user_id AS parcel_id, event_type AS stage, floor(value) AS level, value, event_id FROM events)
    SELECT DISTINCT concat('advisory:t1:', CAST(parcel_id AS STRING), ':irrigate:', stage) AS advisory_id, 'Irrigate at ' || stage || ': ' || CAST(CAST(level AS BIGINT) AS STRING) AS description FROM e WHERE value >= 50.0 AND stage IN ('view', 'click')
    UNION SELECT DISTINCT concat('advisory:t1:', CAST(parcel_id AS STRING), ':terminate:', stage), 'Terminate ' || stage FROM e WHERE parcel_id < 75 AND stage = 'purchase'""")
def advisory_texts(spark: SparkSession, d: str) -> DataFrame:
    """Advisories with their text."""
    e = table(spark, d, "events").selectExpr("user_id AS parcel_id", "event_type AS stage", "event_type AS species", "value", "CAST(floor(value) AS BIGINT) AS level")
    return R.advisories(R.match_rules(e, RULES), "t1", ["stage", "level"]).select("advisory_id", "description").distinct()


@query("""SELECT event_id, parcel_id, stage, previous FROM (SELECT event_id, user_id AS parcel_id, event_type AS stage, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) t WHERE previous IS DISTINCT FROM stage""")
def stage_changes(spark: SparkSession, d: str) -> DataFrame:
    """Observations that change a parcel's stage."""
    e = table(spark, d, "events").selectExpr("event_id", "ts", "user_id AS parcel_id", "event_type AS stage")
    return S.batch_stage_changes(e, ["parcel_id"], ["ts", "event_id"]).select("event_id", "parcel_id", "stage", "previous")


@query("""SELECT user_id AS parcel_id, event_id, place FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM events) t WHERE place <= 50""")
def history_window(spark: SparkSession, d: str) -> DataFrame:
    """The last fifty entries of each log."""
    e = table(spark, d, "events").selectExpr("event_id", "ts", "user_id AS parcel_id")
    return S.bounded_history(e, ["parcel_id"]).select("parcel_id", "event_id", "place")


@query("""WITH r AS (SELECT user_id AS entity_id, first(value ORDER BY ts, value) AS first_value, last(value ORDER BY ts, value) AS last_value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id)
    SELECT *, CASE WHEN last_value - first_value > 0.02 THEN 'up' WHEN last_value - first_value < -0.02 THEN 'down' ELSE 'flat' END AS trend FROM r""")
def series_trend(spark: SparkSession, d: str) -> DataFrame:
    """Change over each series."""
    return D.series_trend(table(spark, d, "events").selectExpr("user_id AS entity_id", "ts", "value"))


POINT = "SELECT c_custkey AS point_id, CAST(-75 + (c_custkey * 13) % 150 AS DOUBLE) + 0.25 AS latitude, CAST(-180 + (c_custkey * 31) % 360 AS DOUBLE) + 0.5 AS longitude FROM customer"


@query(f"""WITH {SITE_SQL}, p AS ({POINT}), k AS (SELECT point_id, site_id, round(12742.0 * asin(sqrt(pow(sin((radians(s.latitude) - radians(p.latitude)) / 2), 2) + cos(radians(p.latitude)) * cos(radians(s.latitude)) * pow(sin((radians(s.longitude) - radians(p.longitude)) / 2), 2))), 3) AS km FROM p, trial_site s),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, site_id) AS r FROM k WHERE km <= 150) t WHERE r = 1)
    SELECT p.point_id, b.site_id, b.km FROM p LEFT JOIN b ON b.point_id = p.point_id""")
def site_nearest(spark: SparkSession, d: str) -> DataFrame:
    """C11: each point's nearest site within a distance."""
    return H.nearest_within(plain(spark, d, POINT), trial_sites(spark, d), 150.0)


@query()
def site_canonical_groups(spark: SparkSession, d: str) -> DataFrame:
    """K4: sites of one municipality merged or split by distance (greedy, so no SQL; tested against plain Python)."""
    sites = trial_sites(spark, d).select("site_id", F.col("municipality").alias("name"), "latitude", "longitude", "rainfall", "soil_ph")
    return H.canonical_sites(sites, 4000.0)


DUP = "SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS k, CASE WHEN l_linenumber IN (1, 2) THEN NULL ELSE l_quantity END AS y, l_tax, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM lineitem"


@query(f"""WITH t AS ({DUP}), r AS (SELECT *, min(y) OVER w AS lo, max(y) OVER w AS hi, row_number() OVER (PARTITION BY k ORDER BY y IS NULL, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_tax DESC) AS place FROM t WINDOW w AS (PARTITION BY k))
    SELECT k, CASE WHEN coalesce(lo = hi, TRUE) THEN hi ELSE y END AS y, l_tax, l_partkey, l_suppkey FROM r WHERE NOT coalesce(lo = hi, TRUE) OR place = 1""")
def trial_dedupe_safe(spark: SparkSession, d: str) -> DataFrame:
    """K6: duplicates merged and filled up unless their yields disagree."""
    rank = [F.col("y").isNull(), *(F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax"))]
    return H.safe_trial_merge(plain(spark, d, DUP), "k", "y", rank, ["y", "l_tax"]).select("k", "y", "l_tax", "l_partkey", "l_suppkey")


KEYED = "SELECT DISTINCT concat(p_type, '|', p_brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('|', substring(md5(CAST(p_partkey AS STRING)), 1, 12)) END) AS k FROM part"


@query(f"""WITH t AS ({KEYED}), b AS (SELECT k, regexp_replace(k, '\\|[0-9a-f]{{12}}$', '') AS base_key FROM t) SELECT base_key, min(k) AS kept_key, count(*) AS copies FROM b GROUP BY base_key""")
def hash_suffix_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """K7: keys that differ only in a hash suffix."""
    return H.strip_hash_suffix(plain(spark, d, KEYED), "k")


LOCATED = """l AS (SELECT c_custkey AS trial_id, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN concat('supplier#', CAST(c_custkey % 120 AS STRING)) WHEN 2 THEN '' ELSE concat('alt', CAST(c_custkey % 60 AS STRING)) END AS location_key FROM customer JOIN nation ON n_nationkey = c_nationkey),
    s AS (SELECT s_suppkey AS site_id, lower(s_name) AS site_key, lower(n_name) AS municipality_key, concat('alt', CAST(s_suppkey AS STRING)) AS other_key FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


@query(f"WITH {LOCATED} SELECT DISTINCT trial_id, site_id FROM l JOIN s ON location_key <> '' AND (location_key = site_key OR location_key = municipality_key OR location_key = other_key)")
def trial_site_link(spark: SparkSession, d: str) -> DataFrame:
    """Trials linked to sites by any of three keys."""
    return H.link_trials(plain(spark, d, f"WITH {LOCATED} SELECT * FROM l"), plain(spark, d, f"WITH {LOCATED} SELECT * FROM s"))


@query(f"""{DOMAIN}, t AS (SELECT DISTINCT trial_id, source_id, crop, yield_kg_ha, note FROM variety_trial),
    f AS (SELECT source_id, crop, avg(yield_kg_ha / note) AS factor FROM t WHERE yield_kg_ha IS NOT NULL AND note > 0 GROUP BY ALL HAVING count(*) >= 20), g AS (SELECT crop, median(factor) AS gf FROM f GROUP BY crop)
    SELECT trial_id, CASE WHEN yield_kg_ha IS NULL AND note IS NOT NULL THEN round(note * coalesce(factor, gf), 1) ELSE yield_kg_ha END AS yield_filled,
        CASE WHEN yield_kg_ha IS NULL AND note IS NOT NULL THEN CASE WHEN factor IS NOT NULL THEN 'direct' WHEN gf IS NOT NULL THEN 'group' END END AS derivation
    FROM t LEFT JOIN f USING (source_id, crop) LEFT JOIN g USING (crop)""")
def derived_yield(spark: SparkSession, d: str) -> DataFrame:
    """Yields derived from notes, directly or by the group's median factor."""
    rows = variety_trials(spark, d).select("trial_id", "source_id", "crop", "yield_kg_ha", "note").distinct()
    return H.derived_yields(rows, "crop").select("trial_id", "yield_filled", "derivation")


@query(f"""{DOMAIN}, n AS (SELECT trial_id, count(DISTINCT site_id) AS k FROM trial_at WHERE site_id IN (SELECT site_id FROM trial_site WHERE rainfall IS NOT NULL) GROUP BY trial_id)
    SELECT DISTINCT v.trial_id, CASE WHEN lower(crop) = 'promo' THEN 'regional' WHEN k > 1 THEN 'regional' WHEN k IS NULL THEN 'unlocated' ELSE 'site' END AS scope FROM variety_trial v LEFT JOIN n ON n.trial_id = v.trial_id""")
def aggregation_scope(spark: SparkSession, d: str) -> DataFrame:
    """Scope of each trial's figure."""
    trials, links, sites = _domain(spark, d)
    rows = trials.select("trial_id", F.when(F.col("crop") == "PROMO", "Region north").otherwise(F.col("crop")).alias("place")).distinct()
    return H.aggregation_scope(rows, _known_places(links, sites), "place").select("trial_id", "scope")


@query("SELECT p_brand, p_name, min(p_size % 2) AS cycle FROM part GROUP BY p_brand, p_name HAVING min(p_size % 2) = max(p_size % 2)")
def cycle_votes(spark: SparkSession, d: str) -> DataFrame:
    """A value is kept only where all votes agree."""
    return H.unanimous(table(spark, d, "part").select("p_brand", "p_name", (F.col("p_size") % 2).alias("cycle")), ["p_brand", "p_name"], "cycle")


@query(f"{DOMAIN} SELECT DISTINCT trial_id FROM variety_trial WHERE trial_id NOT IN (SELECT trial_id FROM trial_at WHERE site_id IN (SELECT site_id FROM trial_site WHERE rainfall IS NOT NULL))")
def orphan_trials(spark: SparkSession, d: str) -> DataFrame:
    """Trials without a site of known rainfall."""
    trials, links, sites = _domain(spark, d)
    return trials.select("trial_id").distinct().join(_known_places(links, sites), "trial_id", "left_anti")


BUNDLE = """r AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'eppo:TRZ' ELSE 'eppo:TRZAX' END AS crop_eppo, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_mktsegment END AS variety, CASE WHEN c_custkey % 13 = 0 THEN 1900 WHEN c_custkey % 17 = 0 THEN NULL ELSE 2010 END AS year,
    CASE WHEN c_custkey % 19 = 0 THEN '' ELSE n_name END AS location, CAST(c_custkey % 8000 AS DOUBLE) AS yield_kg_ha, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 8000 AS DOUBLE) / 1000 END AS note, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Csa' END AS climate_class
    FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@query(f"""WITH {BUNDLE}, known AS (SELECT DISTINCT n_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))
    SELECT id, 'ERROR' AS severity, 'crop missing' AS issue FROM r WHERE crop_eppo IS NULL UNION ALL SELECT id, 'ERROR', 'crop malformed' FROM r WHERE crop_eppo = 'eppo:TRZ'
    UNION ALL SELECT id, 'ERROR', 'variety missing' FROM r WHERE trim(variety) = '' UNION ALL SELECT id, 'ERROR', 'year implausible' FROM r WHERE coalesce(year, 0) <= 1900
    UNION ALL SELECT id, 'ERROR', 'location missing' FROM r WHERE location = '' UNION ALL SELECT id, 'ERROR', 'yield made from note' FROM r WHERE yield_kg_ha = note * 1000
    UNION ALL SELECT id, 'WARNING', 'site without climate' FROM r WHERE climate_class IS NULL UNION ALL SELECT id, 'WARNING', 'yield above bound' FROM r WHERE yield_kg_ha > 5000
    UNION ALL SELECT id, 'ERROR', 'location unknown' FROM r WHERE location <> '' AND location NOT IN (SELECT name FROM known)""")
def bundle_gate(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the validation gate."""
    known = trial_sites(spark, d).where("climate_class IN ('ASIA', 'EUROPE')").select(F.col("municipality").alias("name"))
    return H.bundle_issues(plain(spark, d, f"WITH {BUNDLE} SELECT * FROM r"), known)


@query("""WITH raw AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Heights' WHEN 1 THEN 'mildew' ELSE 'Lodgings' END AS raw_key, CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(p_size % 10 AS DOUBLE) END AS v FROM part)
    SELECT id, CASE raw_key WHEN 'Heights' THEN 'plant_height' WHEN 'mildew' THEN 'mildew_resistance' ELSE 'lodging' END AS trait,
        round(CASE WHEN v IS NULL THEN NULL WHEN raw_key = 'Heights' THEN v WHEN raw_key = 'mildew' THEN greatest(0, least(1, 1 - (v - 1) / 8)) ELSE greatest(0, least(1, (v - 1) / 8)) END, 4) AS value FROM raw""")
def trait_unify(spark: SparkSession, d: str) -> DataFrame:
    """K2: raw measurements under canonical names and scales."""
    size = F.col("p_size")
    raw = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.lit("bsl").alias("source_id"), F.when(size % 3 == 0, "Heights").when(size % 3 == 1, "mildew").otherwise("Lodgings").alias("raw_key"),
        F.when(size % 10 == 0, "n/a").otherwise((size % 10).cast("string")).alias("raw_value"),
    )
    registry = spark.createDataFrame(
        [("bsl", "height", "plant_height", "raw", None), ("bsl", "mildew", "mildew_resistance", "note_1_9", "better"), ("bsl", "lodging", "lodging", "note_1_9", "worse")],
        "source_id string, key string, trait string, scale string, higher_is string",
    )
    return H.unify_traits(raw, registry)


@query("""WITH m AS (SELECT l_orderkey AS k, concat('d', CAST(l_linenumber % 3 AS STRING)) AS name, l_discount AS score FROM lineitem UNION ALL SELECT l_orderkey, 'tax', l_tax FROM lineitem) SELECT k, name, max(score) AS score FROM m GROUP BY k, name""")
def score_merge(spark: SparkSession, d: str) -> DataFrame:
    """The largest score per name over a group's maps."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.create_map(F.concat(F.lit("d"), (F.col("l_linenumber") % 3).cast("string")), "l_discount", F.lit("tax"), "l_tax").alias("scores")
    )
    return H.merge_scores(rows, ["k"], "scores")


@query("""WITH old AS (SELECT o_orderkey AS k, o_totalprice AS a, o_orderstatus AS b, o_orderpriority AS c FROM orders WHERE o_orderstatus <> 'P'), new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice + 1 END AS a, 'X' AS b, 'new' AS c FROM orders WHERE o_totalprice > 100000)
    SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.a ELSE o.a END AS a, coalesce(n.b, o.b) AS b, coalesce(o.c, n.c) AS c FROM old o FULL JOIN new n ON o.k = n.k""")
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A keyed merge with a policy per column."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("a"), F.col("o_orderstatus").alias("b"), F.col("o_orderpriority").alias("c"))
    new = o.where("a > 100000").select("k", F.when(F.col("k") % 4 != 0, F.col("a") + 1).alias("a"), F.lit("X").alias("b"), F.lit("new").alias("c"))
    return H.upsert(o.where("b <> 'P'"), new, ["k"], {"a": "overwrite", "b": "prefer_new", "c": "prefer_old"})


@query("""WITH k AS (SELECT DISTINCT p_type AS entity, p_brand AS attribute FROM part), p AS (SELECT DISTINCT p_type AS entity, p_brand AS attribute FROM part WHERE p_size > 45) SELECT * FROM k EXCEPT SELECT * FROM p""")
def capability_stale(spark: SparkSession, d: str) -> DataFrame:
    """Capabilities that nobody publishes."""
    rows = table(spark, d, "part").select(F.col("p_type").alias("entity"), F.col("p_brand").alias("attribute"), "p_size")
    return C.stale(rows.select("entity", "attribute").distinct(), rows.where("p_size > 45"), ["entity", "attribute"])


@query("""WITH a AS (SELECT DISTINCT p_type AS alias, concat('slug-', lower(p_type)) AS slug FROM part UNION SELECT DISTINCT lower(p_brand), p_brand FROM part), q AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'small' WHEN 2 THEN 'BRAND#11' ELSE 'nothing' END AS alias FROM orders)
    SELECT id, q.alias, coalesce(e.slug, l.slug) AS slug FROM q LEFT JOIN (SELECT alias, min(slug) AS slug FROM a GROUP BY alias) e ON e.alias = q.alias LEFT JOIN (SELECT lower(alias) AS la, min(slug) AS slug FROM a GROUP BY 1) l ON la = lower(q.alias)""")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers to canonical names."""
    part, k = table(spark, d, "part"), F.col("o_orderkey")
    aliases = part.select(F.col("p_type").alias("alias"), F.concat(F.lit("slug-"), F.lower("p_type")).alias("slug")).union(part.select(F.lower("p_brand"), "p_brand")).distinct()
    asked = table(spark, d, "orders").select(k.alias("id"), F.when(k % 4 == 0, "STANDARD").when(k % 4 == 1, "small").when(k % 4 == 2, "BRAND#11").otherwise("nothing").alias("alias"))
    return C.resolve_alias(asked, "alias", aliases).select("id", "alias", "slug")


@query("""WITH s AS (SELECT o_custkey AS plan_id, CAST(o_orderkey % 1000 AS INT) AS seq, CASE o_orderkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'cover' WHEN 2 THEN 'odd' WHEN 3 THEN NULL ELSE 'catch' END AS role, CASE WHEN o_orderkey % 7 = 0 THEN 'burning' ELSE 'harvest' END AS method, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 20 AS e FROM orders)
    SELECT plan_id, 'invalid_role' AS kind, seq AS seq_a, NULL AS seq_b FROM s WHERE role = 'odd' UNION ALL SELECT plan_id, 'invalid_termination_method', seq, NULL FROM s WHERE method = 'burning'
    UNION ALL SELECT a.plan_id, 'window_overlap', a.seq, b.seq FROM s a JOIN s b ON a.plan_id = b.plan_id AND a.seq < b.seq AND a.s <= b.e AND b.s <= a.e""")
def plan_warnings(spark: SparkSession, d: str) -> DataFrame:
    """C17 and part of J61: what is odd about crop plans."""
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    s = table(spark, d, "orders").select(
        F.col("o_custkey").alias("plan_id"), (k % 1000).cast("int").alias("seq"), F.when(k % 5 == 0, "main").when(k % 5 == 1, "cover").when(k % 5 == 2, "odd").when(k % 5 == 4, "catch").alias("role"),
        F.when(k % 7 == 0, "burning").otherwise("harvest").alias("method"), day.alias("start"), F.date_add(day, 20).alias("end"),
    )
    return D.plan_warnings(s)


@query("""SELECT c_custkey AS id, concat_ws('|', upper(c_mktsegment), concat('eppo:', 'ZEAMX'), upper(c_name), n_name, CASE WHEN c_custkey % 9 = 0 THEN 'NOYEAR' ELSE CAST(1990 + c_custkey % 30 AS STRING) END) AS merge_key FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def merge_keys(spark: SparkSession, d: str) -> DataFrame:
    """K1: canonical keys of trials."""
    c, n, k = table(spark, d, "customer"), table(spark, d, "nation"), F.col("c_custkey")
    name = F.concat("c_name", F.when(k % 2 == 0, F.lit(" (T)")).otherwise(F.lit("")))
    year = F.when(k % 9 != 0, (k % 30 + 1990).cast("int"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(k.alias("id"), H.merge_key(F.col("c_mktsegment"), F.lit("eppo:zeamx"), name, F.col("n_name"), year).alias("merge_key"))


@query("""WITH t AS (SELECT p_type, count(*) AS n, count(*) FILTER (p_size > 40) AS k FROM part GROUP BY p_type) SELECT count(*) AS total, count(*) FILTER (k > 20) AS known, round(100.0 * count(*) FILTER (k > 20) / count(*), 1) AS pct FROM t""")
def suitability_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of species that a reference table knows."""
    part = table(spark, d, "part").select(F.col("p_type").alias("species"), "p_size")
    known = part.groupBy("species").agg(F.count_if(F.col("p_size") > 40).alias("k")).where("k > 20")
    return C.coverage(part, known, "species")
