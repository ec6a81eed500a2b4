"""Queries that plan for parcels: crops suggested and rotations of several years, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import decisions as D
from harrow.operators import suggestions as S
from harrow.operators import varieties as V
from harrow.plans.crop_queries import PLACES
from harrow.plans.field_queries import NEAR_MANY, PARCEL
from harrow.plans.queries import NOW, USABLE
from harrow.plans.registry import bound, oracle, plain, query
from harrow.sources.tables import TRIAL_SQL, trial_links, trial_sites, variety_trials

FIELDS = """SELECT c_custkey AS parcel_id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(300 + (c_custkey % 6) * 120 AS DOUBLE) END AS rainfall, CAST(900 + (c_custkey % 2) * 300 AS DOUBLE) AS et0,
    CAST((c_custkey % 3) * 15 AS DOUBLE) AS frost, CAST(400 + (c_custkey % 2) * 500 AS DOUBLE) AS elevation, r_name AS climate_class,
    CASE c_custkey % 4 WHEN 0 THEN 'winter' WHEN 1 THEN 'summer' WHEN 2 THEN 'spring' END AS season, CASE c_custkey % 3 WHEN 0 THEN 'organic' WHEN 1 THEN 'any' END AS management,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(1 + c_custkey % 40 AS DOUBLE) END AS area_ha, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 4 + (c_custkey % 9) / CAST(2 AS DOUBLE) END AS ph,
    CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'Sandy Loam' WHEN 2 THEN 'CLAY' WHEN 3 THEN 'silt' ELSE 'loam' END AS texture, CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(60 + c_custkey % 90 AS DOUBLE) END AS awc_mm
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
OFFERS = """SELECT DISTINCT p_type AS crop, CASE p_type WHEN 'STANDARD' THEN 'winter' WHEN 'SMALL' THEN 'winter,spring' WHEN 'MEDIUM' THEN 'summer' WHEN 'LARGE' THEN 'spring' WHEN 'PROMO' THEN 'summer,winter' END AS slots,
    CASE p_type WHEN 'SMALL' THEN NULL ELSE 100 + length(p_type) * 20 END AS season_days, CASE p_type WHEN 'LARGE' THEN NULL ELSE CAST(5.5 AS DOUBLE) END AS ph_min, CASE p_type WHEN 'MEDIUM' THEN NULL ELSE CAST(7.5 AS DOUBLE) END AS ph_max,
    CASE p_type WHEN 'STANDARD' THEN 'Loam,clay' WHEN 'SMALL' THEN 'sand' END AS textures, length(p_type) - 10 AS frost_damage_c FROM part"""
ENVIRONMENT_KEY = "concat_ws('|', coalesce(CAST(rainfall AS VARCHAR), '-'), et0, frost, elevation, climate_class)"
NEAR_FIELDS = NEAR_MANY.replace(oracle(PARCEL), f"SELECT DISTINCT {ENVIRONMENT_KEY} AS target_id, rainfall, et0, frost, elevation, climate_class, NULL AS crop FROM ({FIELDS})")


@query(f"""{NEAR_FIELDS}, fields AS (SELECT *, {ENVIRONMENT_KEY} AS target_id FROM ({FIELDS})), offers AS (SELECT * REPLACE (string_split(slots, ',') AS slots, string_split(textures, ',') AS textures) FROM ({OFFERS})),
    t AS (SELECT DISTINCT trial_id, crop, variety_norm, year, yield_kg_ha, note FROM variety_trial WHERE {USABLE}),
    m AS (SELECT target_id, t.crop, variety_norm, t.trial_id, year, yield_kg_ha, note, max(coalesce(1.0 / (1.0 + distance), 1.0)) AS ws
        FROM near n JOIN trial_at l ON l.site_id = n.site_id JOIN t ON t.trial_id = l.trial_id WHERE n.rank <= 10 GROUP BY ALL),
    w AS (SELECT *, ws * CASE WHEN {NOW} - year > 0 THEN pow(0.5, ({NOW} - year) / 8.0) ELSE 1.0 END AS w FROM m),
    v AS (SELECT target_id, crop, variety_norm AS variety, round(round(sum(w * yield_kg_ha) / nullif(sum(CASE WHEN yield_kg_ha IS NOT NULL THEN w END), 0), 6), 1) AS y, count(*) AS trial_count FROM w GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, crop ORDER BY y DESC NULLS LAST, variety) AS r FROM v) WHERE r = 1 AND y IS NOT NULL),
    a AS (SELECT f.*, b.variety, CAST(y AS DOUBLE) AS y, trial_count, o.*, (ph IS NOT NULL OR texture IS NOT NULL) AS soil_known, (ph_min IS NOT NULL OR textures IS NOT NULL) AS demands
        FROM fields f JOIN best b ON b.target_id = f.target_id JOIN offers o ON o.crop = b.crop WHERE f.season IS NULL OR list_contains(o.slots, f.season)),
    p AS (SELECT *, coalesce(management = 'organic', FALSE) AS organic, CASE WHEN soil_known AND demands AND ph IS NOT NULL AND ph_min IS NOT NULL AND NOT (ph >= ph_min AND ph <= coalesce(ph_max, 14)) THEN 'ph' END AS acid,
        CASE WHEN soil_known AND demands AND texture IS NOT NULL AND textures IS NOT NULL AND len(list_filter(textures, lambda x: contains(lower(texture), lower(x)))) = 0 THEN 'texture' END AS coarse,
        CASE WHEN et0 <> 0 AND rainfall <> 0 THEN greatest(0, coalesce(season_days, 180) / CAST(365 AS DOUBLE) * et0 - rainfall * CAST(0.7 AS DOUBLE)) END AS lack, coalesce(awc_mm, 100) AS water FROM a),
    q AS (SELECT *, CASE WHEN NOT (soil_known AND demands) THEN 'unknown' WHEN acid IS NULL AND coarse IS NULL THEN 'suitable' ELSE 'warning' END AS soil, round(round(y / 1000 * 180 - 312, 6), 2) AS margin,
        CASE WHEN organic THEN round_even(round(y * CAST(0.8 AS DOUBLE), 6), 0) END AS org, CASE WHEN lack IS NOT NULL THEN CASE WHEN water > 0 THEN lack / water ELSE 999 END END AS ratio FROM p),
    s AS (SELECT *, round(round(y / coalesce(nullif(max(y) OVER (PARTITION BY parcel_id), 0), 1) * 40 + margin / coalesce(nullif(max(margin) OVER (PARTITION BY parcel_id), 0), 1) * 30 + 20
        + CASE soil WHEN 'suitable' THEN 10 WHEN 'warning' THEN 5 ELSE 0 END, 6), 1) AS score FROM q),
    r AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY score DESC, crop) AS rank FROM s)
    SELECT parcel_id, rank, crop, score, variety, y AS yield_kg_ha, org AS organic_yield_kg_ha, trial_count, margin AS margin_eur_ha, round(round(org / 1000 * 180 - 312, 6), 2) AS organic_margin_eur_ha,
        CASE WHEN area_ha > 0 THEN round(round(margin * area_ha, 6), 2) END AS parcel_margin_eur, soil, concat_ws(',', acid, coarse) AS soil_problems, coalesce(frost_damage_c > -5 AND frost > 5, FALSE) AS frost_risk,
        CASE WHEN ratio < 0.5 THEN 'low' WHEN ratio < 1.5 THEN 'medium' WHEN ratio IS NOT NULL THEN 'high' END AS water_demand, round(round(lack, 6), 1) AS water_deficit_mm, round(ratio, 2) AS water_ratio,
        concat_ws(',', CASE WHEN trial_count < 3 THEN 'few_trials' END, CASE WHEN organic THEN 'conventional_trials' END, CASE WHEN NOT soil_known THEN 'no_soil' END) AS gaps FROM r WHERE rank <= 4""")
def crops_for_parcels(spark: SparkSession, d: str) -> DataFrame:
    """The four best crops of every parcel's season, with variety, margins, soil, frost and water."""
    listed = {c: F.split(c, ",") for c in ("slots", "textures")}
    trials = variety_trials(spark, d)
    scored = V.usable(trials).withColumn("scores", F.create_map(F.lit("note"), F.col("note").cast("double")))
    offers = plain(spark, d, OFFERS).withColumns(listed)
    rows = S.suggest_crops(
        plain(spark, d, FIELDS), offers, scored, trial_links(trials), trial_sites(spark, d), NOW, top_n=4, site_limit=10, seed_price=112.0, price_per_t=180.0, operation_cost=40.0
    )
    return rows.withColumns({c: F.array_join(c, ",") for c in ("soil_problems", "gaps")})


PLANNED = """SELECT c_custkey AS parcel_id, CASE c_custkey % 8 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LARGE' WHEN 4 THEN 'PROMO' WHEN 5 THEN 'ECONOMY' WHEN 6 THEN 'UNKNOWN' END AS starting_crop,
    CASE c_custkey % 10 WHEN 9 THEN 1 WHEN 8 THEN NULL ELSE 2 + c_custkey % 5 END AS years, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'much' ELSE CAST(c_custkey % 9 AS STRING) END AS organic_matter_pct FROM customer"""
KINDS = "(SELECT DISTINCT p_type AS a FROM part)"
FOLLOW = f"""SELECT x.a AS previous, y.a AS crop, (length(x.a) * 7 + length(y.a) * 13 + ascii(y.a)) % 50 AS place FROM {KINDS} AS x JOIN {KINDS} AS y ON x.a <> y.a WHERE x.a <> 'LARGE'
    UNION ALL SELECT 'none', a, 40 - length(a) FROM {KINDS} AS z WHERE a <> 'MEDIUM'"""
BARRED = f"""SELECT x.a AS crop_a, y.a AS crop_b, CASE WHEN x.a <> 'SMALL' THEN concat('not after ', x.a) END AS reason FROM {KINDS} AS x JOIN {KINDS} AS y ON (length(x.a) + length(y.a)) % 3 = 0"""
HARM = "SELECT p_type AS crop, p_brand AS pest FROM part WHERE p_size >= 46"
FIGURES = [
    "CAST(length(crop) AS DOUBLE) / 2 AS carbon",
    "CASE crop WHEN 'PROMO' THEN CAST(60 AS DOUBLE) WHEN 'ECONOMY' THEN CAST(25 AS DOUBLE) WHEN 'SMALL' THEN NULL ELSE CAST(0 AS DOUBLE) END AS fixed_n",
    "CAST(length(crop) * 9 AS DOUBLE) AS required_n",
    "CASE crop WHEN 'MEDIUM' THEN NULL ELSE 4 END AS operations",
]
ROTATED = f"""WITH RECURSIVE {TRIAL_SQL}, parcels AS ({PLANNED}), follow AS ({FOLLOW}), barred AS (SELECT crop_a, crop_b, min(coalesce(reason, 'not after this crop')) AS reason FROM ({BARRED}) GROUP BY ALL), harm AS (SELECT DISTINCT * FROM ({HARM})),
    pests AS (SELECT x.crop AS a, y.crop AS b, count(*) AS n FROM harm x JOIN harm y ON x.pest = y.pest AND x.crop <> y.crop GROUP BY ALL),
    means AS (SELECT crop, variety_norm AS variety, round(avg(yield_kg_ha), 1) AS y FROM variety_trial WHERE yield_kg_ha IS NOT NULL GROUP BY ALL),
    crops AS (SELECT crop, arg_min(variety, r) AS variety, arg_min(y, r) AS y, {", ".join(FIGURES)} FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY y DESC, variety) AS r FROM means) GROUP BY crop),
    ranked AS (SELECT previous, crop, row_number() OVER (PARTITION BY previous ORDER BY place, crop) AS i FROM follow),
    members AS (SELECT previous AS pool_of, i, crop FROM ranked WHERE i <= 10 UNION ALL SELECT DISTINCT starting_crop, 0, starting_crop FROM parcels WHERE starting_crop IS NOT NULL),
    pool AS (SELECT m.pool_of, row_number() OVER w - 1 AS at, count(*) OVER (PARTITION BY m.pool_of) AS n, m.crop, coalesce(lag(m.crop) OVER w, last_value(m.crop) OVER (PARTITION BY m.pool_of ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before
        FROM members m WINDOW w AS (PARTITION BY m.pool_of ORDER BY i)),
    full_ AS (SELECT p.*, c.variety, coalesce(c.y, 0) AS y, coalesce(carbon, 0) AS carbon, coalesce(fixed_n, 0) AS fixed, coalesce(required_n, 0) AS required, coalesce(operations, 5) AS operations, b.reason, coalesce(h.n, 0) AS pests
        FROM pool p LEFT JOIN crops c ON c.crop = p.crop LEFT JOIN barred b ON b.crop_a = p.before AND b.crop_b = p.crop LEFT JOIN pests h ON h.a = p.before AND h.b = p.crop),
    begun AS (SELECT *, coalesce(starting_crop, 'none') AS pool_of, coalesce(round(TRY_CAST(organic_matter_pct AS DOUBLE) * 15, 1), 50) AS initial_n FROM parcels),
    plan AS (SELECT parcel_id, years, initial_n, pool_of, 1 AS year_no, f.crop, f.variety, f.y, f.carbon, f.y * 0.2::DOUBLE - (90 + f.operations * 40) AS margin, f.fixed - f.required AS balance, greatest(0, initial_n + f.fixed - f.required) AS soil_n,
            CAST(NULL AS VARCHAR) AS reason, 0::BIGINT AS pests FROM begun JOIN full_ f USING (pool_of) WHERE f.at = 0 AND years BETWEEN 2 AND 6
        UNION ALL SELECT parcel_id, years, initial_n, p.pool_of, year_no + 1, f.crop, f.variety, f.y, f.carbon, f.y * 0.2::DOUBLE - (90 + f.operations * 40), f.fixed - f.required + p.soil_n, greatest(0, p.soil_n + f.fixed - f.required), f.reason, f.pests
        FROM plan p JOIN full_ f ON f.pool_of = p.pool_of AND f.at = p.year_no % f.n WHERE year_no < years)"""


def _rotations(spark: SparkSession, d: str) -> DataFrame:
    trials = variety_trials(spark, d).where("yield_kg_ha IS NOT NULL")
    means = trials.groupBy("crop", F.col("variety_norm").alias("variety")).agg(F.round(F.avg("yield_kg_ha"), 1).cast("double").alias("yield_kg_ha"))
    best = V.top_per_group(means, ["crop"], [F.col("yield_kg_ha").desc(), F.col("variety")], 1).selectExpr("crop", "variety", "yield_kg_ha", *FIGURES)
    harm = plain(spark, d, HARM)
    return S.rotation_plans(
        plain(spark, d, PLANNED), plain(spark, d, FOLLOW), best, plain(spark, d, BARRED), D.shared_pests(harm, harm), seed_price=90.0, harvest_price=0.2, operation_cost=40.0
    )


@query(f"""{ROTATED} SELECT parcel_id, year_no, crop, variety, round(round(y, 6), 1) AS yield_kg_ha, carbon, round(round(margin, 6), 2) AS margin_eur_ha, round(round(balance, 6), 1) AS n_balance, round(round(soil_n, 6), 1) AS soil_n, reason,
    pests AS shared_pests, CASE WHEN pests >= 5 THEN 'high' WHEN pests >= 2 THEN 'medium' WHEN pests = 1 THEN 'low' ELSE 'none' END AS pest_risk FROM plan""")
def rotation_plan_years(spark: SparkSession, d: str) -> DataFrame:
    """Each year of every parcel's rotation: yield, margin, nitrogen, and what speaks against following the crop before."""
    return S.rotation_years(_rotations(spark, d))


@query(f"""{ROTATED} SELECT b.parcel_id, CASE WHEN NOT coalesce(b.years BETWEEN 2 AND 6, FALSE) THEN 'years' WHEN p.n IS NULL THEN 'no_crops' ELSE 'ok' END AS status, CASE WHEN p.n IS NOT NULL THEN b.initial_n END AS initial_n,
    round(round(yield, 6), 1) AS total_yield_kg_ha, round(round(carbon, 6), 2) AS total_carbon, round(round(margin, 6), 2) AS total_margin_eur_ha, round(round(soil_n, 6), 1) AS final_n FROM begun b LEFT JOIN
    (SELECT parcel_id, count(*) AS n, sum(y) AS yield, sum(carbon) AS carbon, sum(margin) AS margin, arg_max(soil_n, year_no) AS soil_n FROM plan GROUP BY parcel_id) p ON p.parcel_id = b.parcel_id""")
def rotation_plan_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of every parcel's rotation and the nitrogen that it leaves; parcels without a plan say why."""
    return _rotations(spark, d).drop("plan")


SURVEY = "SELECT c_custkey AS parcel_id, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'loam' WHEN 2 THEN 'andy_l' WHEN 3 THEN 'Clay' WHEN 4 THEN 'clay' ELSE '' END AS texture FROM customer"
MEASURED = """SELECT o_custkey AS parcel_id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS climate_class, CAST(o_orderkey % 90 AS INT) AS frost_days, CAST(400 + o_orderkey % 500 AS INT) AS rainfall, CAST(800 + o_orderkey % 300 AS INT) AS et0
    FROM orders WHERE o_totalprice > 200000"""


@query(f"""WITH {oracle(PLACES)}, e AS (SELECT parcel_id, CASE WHEN parcel_id % 3 = 0 THEN 'Csa' END AS climate_class FROM parcels), t AS (SELECT parcel_id, nullif(texture, '') AS texture FROM ({SURVEY})),
    site AS (SELECT s_suppkey AS site_id, CASE s_suppkey % 4 WHEN 0 THEN 'Calcic Cambisol' WHEN 1 THEN 'Vertisol' WHEN 2 THEN NULL ELSE 'Haplic Luvisol' END AS soil_type, CASE s_suppkey % 5 WHEN 0 THEN 'clay' WHEN 1 THEN 'loam' WHEN 2 THEN 'sandy_loam' WHEN 3 THEN 'Silty-Clay' ELSE NULL END AS soil_texture FROM supplier),
    g AS (SELECT texture, arg_min(coalesce(soil_type, ''), site_id) AS soil_group FROM (SELECT DISTINCT texture FROM t WHERE texture IS NOT NULL) x JOIN site ON contains(soil_texture, x.texture) GROUP BY texture),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY climate_class NULLS FIRST, frost_days, rainfall, et0) AS r FROM ({MEASURED})) WHERE r = 1)
    SELECT e.parcel_id, coalesce(m.climate_class, e.climate_class) AS climate_class, t.texture, nullif(soil_group, '') AS soil_group, CASE WHEN t.texture IS NULL THEN 'unavailable' ELSE 'soil_survey' END AS soil_source,
        frost_days, rainfall, et0, CASE WHEN m.parcel_id IS NOT NULL THEN 'reanalysis' WHEN e.climate_class IS NOT NULL THEN 'nearby_site' ELSE 'unavailable' END AS climate_source
    FROM e LEFT JOIN t ON t.parcel_id = e.parcel_id LEFT JOIN g ON g.texture = t.texture LEFT JOIN m ON m.parcel_id = e.parcel_id""")
def parcel_soil_climate(spark: SparkSession, d: str) -> DataFrame:
    """The soil's group by the texture, and the climate of a reanalysis before that of a site nearby."""
    places = bound(spark, d, f"WITH {PLACES} SELECT parcel_id, CASE WHEN parcel_id % 3 = 0 THEN 'Csa' END AS climate_class FROM parcels")
    return S.soil_and_climate(places, plain(spark, d, SURVEY), trial_sites(spark, d), plain(spark, d, MEASURED))
