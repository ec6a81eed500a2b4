"""Queries over the crop catalogue and parcels, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import crops as K
from harrow.plans.registry import bound, oracle, query

#: The catalogue, bound to the driver's tables.
CATALOG = """
    crops AS (SELECT n_nationkey AS crop_id, n_name AS name, concat('Sativa ', lower(n_name)) AS scientific_name, concat('CR', CAST(100 + n_nationkey AS STRING)) AS eppo,
        CASE n_regionkey WHEN 0 THEN 'Fabaceae' WHEN 1 THEN 'Poaceae' WHEN 2 THEN NULL ELSE 'Rosaceae' END AS family FROM {nation}),
    varieties AS (SELECT c_custkey AS variety_id, CASE WHEN c_acctbal < -900 THEN NULL ELSE c_nationkey END AS crop_id, c_mktsegment AS name FROM {customer}),
    params AS (SELECT s_suppkey AS param_id, CASE WHEN n_regionkey = 3 THEN NULL ELSE n_nationkey END AS crop_id, concat('stage', CAST(s_suppkey % 5 AS STRING)) AS stage,
        CASE WHEN s_acctbal > 0 THEN s_acctbal / 10000 ELSE CAST(0 AS DOUBLE) END AS kc, CASE WHEN s_acctbal > 5000 THEN CAST(1.5 AS DOUBLE) END AS d1,
        CASE WHEN s_suppkey % 7 = 0 THEN CAST(0.2 AS DOUBLE) END AS mds_ref, n_name AS name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey),
    heat AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS crop_id, 30 + n_nationkey % 10 AS heat_damage_c FROM {nation}),
    soil AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey END AS crop_id, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS crop FROM {nation}),
    nutrients AS (SELECT n_nationkey AS crop_id, n_name AS crop, CASE p_partkey % 3 WHEN 0 THEN 'nitrogen' WHEN 1 THEN 'phosphorus' ELSE 'potassium' END AS element,
        CAST(floor(p_retailprice) AS DOUBLE) / 1024 AS uptake FROM {part} JOIN {nation} ON n_nationkey = p_size % 31)"""


def catalog(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [bound(spark, d, f"WITH {CATALOG} SELECT * FROM {name}") for name in names]


@query(f"""WITH {oracle(CATALOG)} SELECT c.name, scientific_name, CASE c.name WHEN 'NATION_3' THEN 'French bean' ELSE concat(upper(substring(c.name, 1, 1)), lower(substring(c.name, 2))) END AS common_name,
    count(DISTINCT stage) AS stage_count, count(DISTINCT param_id) AS params_count, count(DISTINCT param_id) > 0 AS has_phenology
    FROM crops c LEFT JOIN params p ON p.name = c.name GROUP BY c.name, scientific_name""")
def species_list(spark: SparkSession, d: str) -> DataFrame:
    """All species with the numbers of their stages and parameter sets."""
    crops, params = catalog(spark, d, "crops", "params")
    return K.species_list(crops, params, {"NATION_3": "French bean"})


CATALOG_SQL = f"""WITH {oracle(CATALOG)} SELECT c.crop_id, c.name, scientific_name, count(DISTINCT variety_id) AS variety_count, count(DISTINCT param_id) > 0 AS has_kc, count(h.crop_id) > 0 AS has_thermal
    FROM crops c LEFT JOIN varieties v ON v.crop_id = c.crop_id LEFT JOIN params p ON p.crop_id = c.crop_id LEFT JOIN heat h ON h.crop_id = c.crop_id """


@query(CATALOG_SQL + "GROUP BY c.crop_id, c.name, scientific_name")
def crop_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Crops with numbers of varieties and what is known of them."""
    return K.crop_catalog(*catalog(spark, d, "crops", "varieties", "params", "heat"))


@query(CATALOG_SQL + "WHERE lower(c.name) LIKE '%on_1%' OR lower(scientific_name) LIKE '%on_1%' GROUP BY c.crop_id, c.name, scientific_name")
def crop_search(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue for a part of a name."""
    return K.crop_catalog(*catalog(spark, d, "crops", "varieties", "params", "heat"), search="On_1")


@query(f"""WITH {oracle(CATALOG)} SELECT c.crop_id, c.name, EXISTS (SELECT 1 FROM params p WHERE p.crop_id = c.crop_id AND kc <> 0) AS kc, EXISTS (SELECT 1 FROM params p WHERE p.crop_id = c.crop_id AND d1 <> 0) AS d1_d2,
    EXISTS (SELECT 1 FROM params p WHERE p.crop_id = c.crop_id AND mds_ref <> 0) AS mds, EXISTS (SELECT 1 FROM heat h WHERE h.crop_id = c.crop_id) AS thermal,
    EXISTS (SELECT 1 FROM soil s WHERE s.crop_id = c.crop_id) AS soil_suitability, EXISTS (SELECT 1 FROM nutrients n WHERE n.crop_id = c.crop_id) AS npk,
    coalesce((SELECT string_agg(DISTINCT v.name, ',' ORDER BY v.name) FROM varieties v WHERE v.crop_id = c.crop_id), '') AS varieties FROM crops c""")
def crop_detail(spark: SparkSession, d: str) -> DataFrame:
    """One crop's data flags and varieties, for every crop."""
    rows = K.crop_detail(*catalog(spark, d, "crops", "varieties", "params", "heat", "soil", "nutrients"))
    return rows.withColumn("varieties", F.array_join("varieties", ","))


@query(f"""WITH {oracle(CATALOG)}, s AS (SELECT 'thermal' AS kind, count(*) AS total, count(CASE WHEN crop_id IN (SELECT crop_id FROM heat) THEN 1 END) AS "with" FROM crops
        UNION ALL SELECT 'npk', count(*), count(CASE WHEN crop_id IN (SELECT crop_id FROM nutrients) THEN 1 END) FROM crops)
    SELECT *, total - "with" AS without FROM s""")
def catalog_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many species have tolerances and nutrient profiles."""
    crops, heat, nutrients = catalog(spark, d, "crops", "heat", "nutrients")
    found = [K.coverage(crops, t, "crop_id").withColumn("kind", F.lit(n)) for n, t in (("thermal", heat), ("npk", nutrients))]
    return found[0].unionByName(found[1])


ASKED = "asked AS (SELECT DISTINCT lower(substring(n_name, 5, 4)) AS asked FROM {nation} UNION SELECT DISTINCT lower(r_name) FROM {region})"


@query(f"""WITH {oracle(CATALOG)}, {oracle(ASKED)}, f AS (SELECT asked, max(CASE WHEN p.crop_id IS NOT NULL THEN 1 END) AS a, max(CASE WHEN h.crop_id IS NOT NULL THEN 1 END) AS b, max(CASE WHEN n.crop_id IS NOT NULL THEN 1 END) AS c
        FROM asked LEFT JOIN crops k ON contains(lower(k.name), asked) OR contains(lower(scientific_name), asked) LEFT JOIN params p ON p.crop_id = k.crop_id LEFT JOIN heat h ON h.crop_id = k.crop_id
        LEFT JOIN (SELECT DISTINCT crop_id FROM nutrients) n ON n.crop_id = k.crop_id GROUP BY asked)
    SELECT asked, concat_ws(',', CASE WHEN a IS NULL THEN 'd1,d2,mds' END, CASE WHEN b IS NULL THEN 'thermal' END, CASE WHEN c IS NULL THEN 'npk' END) AS gaps FROM f""")
def data_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds of data are missing for a part of a crop's name."""
    asked = bound(spark, d, f"WITH {ASKED} SELECT * FROM asked")
    return K.data_gaps(asked, *catalog(spark, d, "crops", "params", "heat", "nutrients")).withColumn("gaps", F.array_join("gaps", ","))


LAYERS = """
    static AS (SELECT concat('CR', CAST(100 + n_nationkey AS STRING)) AS eppo, CAST(1 + n_nationkey % 4 AS DOUBLE) AS carbon_fixed_tco2e_ha, 3 + n_nationkey % 5 AS operations_count,
        CAST(100 + n_nationkey AS DOUBLE) AS n_requirement_kg_ha, CAST(n_nationkey * 5 AS DOUBLE) AS n_fixation_kg_ha, 120 + n_nationkey AS growing_season_days FROM {nation} WHERE n_regionkey <> 3),
    knowledge AS (SELECT concat('CR', CAST(100 + n_nationkey AS STRING)) AS eppo, CASE WHEN s_acctbal > 2000 THEN 'n_fixation_kg_ha' ELSE 'other' END AS parameter, CAST(floor(s_acctbal) AS DOUBLE) / 64 AS value
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 4)),
    cycles AS (SELECT upper(concat(' Sativa ', n_name)) AS scientific_name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 80 + n_nationkey END AS cycle_min, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 151 END AS cycle_max
        FROM {nation} WHERE n_regionkey <> 2)"""
DEFAULT_REFERENCE = {"carbon_fixed_tco2e_ha": 2.5, "operations_count": 5, "n_requirement_kg_ha": 90.0, "n_fixation_kg_ha": 0.0, "growing_season_days": 180}


@query(f"""WITH {oracle(CATALOG)}, {oracle(LAYERS)}, m AS (SELECT eppo, avg(value) AS measured FROM knowledge WHERE parameter = 'n_fixation_kg_ha' GROUP BY eppo),
    j AS (SELECT c.eppo, coalesce(carbon_fixed_tco2e_ha, 2.5) AS carbon_fixed_tco2e_ha, coalesce(operations_count, 5) AS operations_count, coalesce(n_requirement_kg_ha, 90.0) AS req, coalesce(n_fixation_kg_ha, 0.0) AS fix,
        coalesce(growing_season_days, 180) AS days, measured, lower(coalesce(family, '')) AS family, nullif(cycle_min, 0) AS lo, nullif(cycle_max, 0) AS hi
        FROM crops c LEFT JOIN static s ON s.eppo = c.eppo LEFT JOIN m ON m.eppo = c.eppo LEFT JOIN cycles y ON lower(trim(y.scientific_name)) = lower(trim(c.scientific_name)))
    SELECT eppo, carbon_fixed_tco2e_ha, operations_count, CASE WHEN measured IS NULL AND family LIKE '%fabaceae%' THEN 15.0 ELSE req END AS n_requirement_kg_ha,
        CASE WHEN measured IS NOT NULL THEN round(measured, 1) WHEN family LIKE '%fabaceae%' THEN greatest(fix, 60.0) WHEN family LIKE '%poaceae%' THEN 0.0 ELSE fix END AS n_fixation_kg_ha,
        CAST(coalesce((lo + hi) // 2, lo, hi, days) AS INT) AS growing_season_days, CASE WHEN measured IS NOT NULL THEN 'measured' WHEN family LIKE '%fabaceae%' THEN 'Fabaceae' WHEN family LIKE '%poaceae%' THEN 'Poaceae' END AS n_fixation_source,
        CASE WHEN coalesce(lo, hi) IS NOT NULL THEN 'growing cycle' END AS growing_season_source FROM j""")
def crop_reference(spark: SparkSession, d: str) -> DataFrame:
    """Reference values from the first layer that knows them."""
    crops, = catalog(spark, d, "crops")
    static, knowledge, cycles = (bound(spark, d, f"WITH {LAYERS} SELECT * FROM {n}") for n in ("static", "knowledge", "cycles"))
    taxonomy = crops.select("eppo", "family", "scientific_name")
    return K.crop_reference(crops.select("eppo"), static, knowledge, taxonomy, cycles, DEFAULT_REFERENCE)


GRAIN = """grain AS (SELECT p_partkey AS variety_id, CASE p_size % 5 WHEN 0 THEN 'TRZAX' WHEN 1 THEN 'avesa' WHEN 2 THEN 'ZEAXX' WHEN 3 THEN 'PIBSX' ELSE 'NOONE' END AS eppo,
    CAST(floor(p_retailprice) AS DOUBLE) AS yield_kg_ha, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size % 25 AS DOUBLE) END AS crude_protein_pct FROM {part})"""


@query(f"""WITH {oracle(GRAIN)} SELECT variety_id, CASE upper(eppo) WHEN 'TRZAX' THEN 'contains_gluten' WHEN 'AVESA' THEN 'gluten_free_caveat' WHEN 'ZEAXX' THEN 'gluten_free' WHEN 'PIBSX' THEN 'gluten_free' ELSE 'unknown' END AS gluten,
    round(CASE WHEN crude_protein_pct > 0 THEN yield_kg_ha * 0.45::DOUBLE * crude_protein_pct / 100 ELSE yield_kg_ha * 12.0::DOUBLE / 100 END, 1) AS protein_kg_ha,
    CASE WHEN crude_protein_pct > 0 THEN 'variety_trials' ELSE 'generic_12pct' END AS protein_source, CASE WHEN eppo = 'TRZAX' THEN 'winter' ELSE 'summer,winter' END AS slots FROM grain""")
def grain_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Gluten, grain protein and seasons of varieties."""
    rows = bound(spark, d, f"WITH {GRAIN} SELECT * FROM grain")
    slots = K.season_slots(F.when(F.col("eppo") == "TRZAX", F.array(F.lit("winter"))))
    return rows.select(
        "variety_id", K.gluten_status(F.col("eppo")).alias("gluten"), K.grain_protein(F.col("yield_kg_ha"), F.col("crude_protein_pct")).alias("p"), F.array_join(slots, ",").alias("slots")
    ).select("variety_id", "gluten", "p.*", "slots")


COVERS = """covers AS (SELECT p_partkey AS id, p_size / CAST(8 AS DOUBLE) AS cover_biomass_t_ha, CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_size % 4) * CAST(0.75 AS DOUBLE) END AS n_content_pct,
    CASE WHEN p_size % 2 = 0 THEN 'legume' ELSE 'grass' END AS cover_type, CAST(p_size % 6 * 20 AS DOUBLE) AS n_fixation_kg_ha, CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS DOUBLE) END AS protein_yield_kg_ha,
    CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS harvest_index, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(22 AS DOUBLE) END AS protein_content_pct,
    CASE WHEN p_size % 5 = 0 THEN 'organic' ELSE 'any' END AS management FROM {part})"""


@query(f"""WITH {oracle(COVERS)}, t AS (SELECT *, CASE WHEN n_content_pct > 0 THEN cover_biomass_t_ha * 1000 * (n_content_pct / 100) ELSE 0 END AS total,
        CASE WHEN cover_type = 'legume' THEN n_fixation_kg_ha END AS fixed, protein_yield_kg_ha * CASE WHEN management = 'organic' THEN 0.8::DOUBLE ELSE 1 END * coalesce(harvest_index, 0.35) * (coalesce(protein_content_pct, 25) / 100) AS protein FROM covers)
    SELECT id, CASE WHEN total > 0 THEN round(total, 1) END AS n_cover_total_kg_ha, CASE WHEN total > 0 THEN round(total * 0.5::DOUBLE, 1) END AS n_cover_available_kg_ha,
        CASE WHEN fixed <> 0 THEN round(fixed, 1) END AS n_protein_fixed_kg_ha, round_even(protein, 0) AS protein_kg_ha FROM t""")
def n_fixation_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Nitrogen of cover crops and the protein that follows."""
    rows = K.n_fixation_estimate(bound(spark, d, f"WITH {COVERS} SELECT * FROM covers"))
    return rows.select("id", "n_cover_total_kg_ha", "n_cover_available_kg_ha", "n_protein_fixed_kg_ha", "protein_kg_ha")


SEQUENCES = """sequences AS (SELECT p_partkey AS id, CASE p_size % 7 WHEN 0 THEN 'Csa' WHEN 1 THEN 'BSk' WHEN 2 THEN 'Cfb' WHEN 3 THEN 'Dfa' WHEN 4 THEN 'Dfb' WHEN 5 THEN 'BSh' ELSE 'Cfa' END AS climate_class,
    CAST(700 + floor(p_retailprice) AS DOUBLE) AS cover_gdd, CAST(900 + p_size * 7 AS DOUBLE) AS protein_gdd FROM {part})"""


@query(f"""WITH {oracle(SEQUENCES)}, w AS (SELECT *, CASE climate_class WHEN 'BSk' THEN 8 WHEN 'BSh' THEN 12 WHEN 'Csa' THEN 10 WHEN 'Cfb' THEN 5 WHEN 'Dfa' THEN 10 ELSE 8 END AS rate,
        CASE climate_class WHEN 'BSk' THEN 6 WHEN 'Cfb' THEN 6 WHEN 'BSh' THEN 4 WHEN 'Dfa' THEN 6 WHEN 'Dfb' THEN 6 ELSE 5 END AS term,
        CASE climate_class WHEN 'BSk' THEN '10-01' WHEN 'Cfb' THEN '09-15' WHEN 'Dfa' THEN '09-01' WHEN 'Dfb' THEN '08-15' ELSE '10-15' END AS cover,
        CASE climate_class WHEN 'BSk' THEN '04-15' WHEN 'Cfb' THEN '03-15' WHEN 'Dfa' THEN '04-15' WHEN 'Dfb' THEN '05-01' WHEN 'BSh' THEN '03-15' ELSE '04-01' END AS protein FROM sequences),
    e AS (SELECT *, make_date(2027, term, 15) + CAST(trunc((cover_gdd - 1200) / rate) AS INT) AS ended FROM w),
    s AS (SELECT *, greatest(ended + 10, CAST(concat('2027-', protein) AS DATE)) AS sown FROM e)
    SELECT id, concat('2026-', cover) AS cover_crop_sowing_date, CAST(ended AS STRING) AS termination_date, CAST(sown AS STRING) AS protein_crop_sowing_date,
        CAST(sown + CAST(trunc(protein_gdd / rate) AS INT) AS STRING) AS protein_crop_harvest_date, rate AS gdd_per_day_spring FROM s""")
def sequence_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of a cover crop and the protein crop after it."""
    return K.sequence_dates(bound(spark, d, f"WITH {SEQUENCES} SELECT * FROM sequences")).drop("climate_class", "cover_gdd", "protein_gdd")


OFFERS = """offers AS (SELECT s_suppkey AS parcel_id, n_name AS crop, CASE WHEN (s_suppkey + n_nationkey) % 9 = 0 THEN NULL ELSE CAST((s_suppkey * 131 + n_nationkey * 977) % 9000 AS DOUBLE) END AS expected_yield_kg_ha,
    1 + n_nationkey % 7 AS operations_count, CAST(n_nationkey % 6 AS DOUBLE) / 2 AS carbon_fixed_tco2e_ha, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(4 + s_suppkey % 5 AS DOUBLE) END AS soil_ph,
    CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(5.5 AS DOUBLE) END AS ph_min, CAST(7.5 AS DOUBLE) AS ph_max FROM {supplier} JOIN {nation} ON n_regionkey = s_suppkey % 5)"""


@query(f"""WITH {oracle(OFFERS)}, r AS (SELECT parcel_id, crop, round(coalesce(expected_yield_kg_ha, 0), 1) AS expected_yield_kg_ha, round(40 + operations_count * 25.0::DOUBLE, 2) AS total_cost_eur_ha,
        round(coalesce(expected_yield_kg_ha, 0) * 0.2::DOUBLE - (40 + operations_count * 25.0::DOUBLE), 2) AS net_margin_eur_ha, carbon_fixed_tco2e_ha,
        CASE WHEN ph_min IS NOT NULL AND soil_ph IS NOT NULL AND NOT soil_ph BETWEEN ph_min AND ph_max THEN 'warning' ELSE 'suitable' END AS soil FROM offers),
    b AS (SELECT *, coalesce(nullif(max(expected_yield_kg_ha) OVER w, 0), 1) AS my, coalesce(nullif(max(net_margin_eur_ha) OVER w, 0), 1) AS mm, coalesce(nullif(max(carbon_fixed_tco2e_ha) OVER w, 0), 1) AS mc FROM r WINDOW w AS (PARTITION BY parcel_id)),
    s AS (SELECT parcel_id, crop, expected_yield_kg_ha, total_cost_eur_ha, net_margin_eur_ha, carbon_fixed_tco2e_ha, soil,
        round(40 * expected_yield_kg_ha / my + 30 * net_margin_eur_ha / mm + 20 * carbon_fixed_tco2e_ha / mc + CASE WHEN soil = 'suitable' THEN 10 ELSE 5 END, 1) AS composite_score FROM b)
    SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY net_margin_eur_ha DESC, crop) AS by_margin, row_number() OVER (PARTITION BY parcel_id ORDER BY carbon_fixed_tco2e_ha DESC, crop) AS by_carbon,
        row_number() OVER (PARTITION BY parcel_id ORDER BY composite_score DESC, crop) AS by_score FROM s""")
def compare_crops(spark: SparkSession, d: str) -> DataFrame:
    """Crops of each parcel compared, with three rankings."""
    return K.compare_crops(bound(spark, d, f"WITH {OFFERS} SELECT * FROM offers"), ["parcel_id"], seed_price=40.0, harvest_price=0.2, operation_cost=25.0)


CHANGES = """changes AS (SELECT a.n_name AS baseline, lower(b.n_name) AS scenario FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey WHERE a.n_name <> b.n_name),
    rules AS (SELECT lower(a.n_name) AS crop_a, b.n_name AS crop_b, (a.n_nationkey + b.n_nationkey) % 4 AS interval_years, 'shared pests' AS reason,
        CASE a.n_nationkey % 3 WHEN 0 THEN 'benefit' WHEN 1 THEN 'restriction' END AS effect FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey)"""


@query(f"""WITH {oracle(CATALOG)}, {oracle(CHANGES)}, n AS (SELECT lower(crop) AS c, sum(uptake) AS n FROM nutrients WHERE element = 'nitrogen' GROUP BY lower(crop)),
    j AS (SELECT baseline, scenario, r.interval_years AS years, r.reason, s.crop IS NOT NULL AS soil_ok, coalesce(n1.n, 0) - coalesce(n0.n, 0) AS delta FROM changes c
        LEFT JOIN rules r ON r.crop_a = lower(baseline) AND lower(r.crop_b) = lower(scenario) AND coalesce(r.effect, 'restriction') = 'restriction' AND r.interval_years > 0
        LEFT JOIN soil s ON lower(s.crop) = lower(scenario) LEFT JOIN n n0 ON n0.c = lower(baseline) LEFT JOIN n n1 ON n1.c = lower(scenario)),
    i AS (SELECT *, concat_ws('; ', CASE WHEN years IS NOT NULL THEN 'rotation constraint violated' END, CASE WHEN NOT soil_ok THEN 'soil suitability issues' END, CASE WHEN abs(delta) > 0 THEN 'fertilizer adjustment needed' END) AS issues FROM j)
    SELECT baseline, scenario, years IS NULL AS rotation_ok, CASE WHEN years IS NULL THEN '' ELSE concat(reason, '. Minimum interval: ', years, ' years.') END AS rotation_issue, soil_ok,
        CASE WHEN abs(delta) > 1 THEN round(delta, 1) END AS n_delta, CASE WHEN delta > 1 THEN 'Scenario needs more N than baseline' WHEN delta < -1 THEN 'Scenario needs less N than baseline' END AS note,
        CASE WHEN issues = '' THEN concat(scenario, ' is a suitable alternative to ', baseline, '.') ELSE concat(scenario, ' vs ', baseline, ': ', issues, '. Review before adopting.') END AS recommendation FROM i""")
def crop_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """What changing from one crop to another means."""
    asked, rules = (bound(spark, d, f"WITH {CHANGES} SELECT * FROM {n}") for n in ("changes", "rules"))
    return K.scenarios(asked, rules, *catalog(spark, d, "soil", "nutrients"))


@query("""SELECT user_id AS station, CASE WHEN sum(et0) > 0 THEN round(sum(et0), 1) END AS et0_mm FROM (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS DOUBLE) / 8 END AS et0 FROM events) t
    WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY user_id""")
def weekly_et0(spark: SparkSession, d: str) -> DataFrame:
    """Sum of known daily values in a period."""
    points = bound(spark, d, "SELECT user_id AS station, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS DOUBLE) / 8 END AS et0 FROM {events}")
    return K.weekly_et0(points, ["station"], "2024-01-03", "2024-01-20")


ASSESSED = """assessed AS (SELECT event_id AS assessment_id, user_id AS tenant, ts AS assessed_at, CASE user_id % 3 WHEN 0 THEN 'Wheat winter' WHEN 1 THEN 'barley' END AS species, event_type AS stage,
        CASE WHEN event_type = 'click' THEN NULL ELSE CAST(floor(value) AS DOUBLE) END AS kc, CAST(NULL AS DOUBLE) AS ky, CASE WHEN event_id % 2 = 0 THEN CAST(0 AS DOUBLE) END AS d1, CASE WHEN event_id % 3 = 0 THEN CAST(-1.5 AS DOUBLE) END AS nwsb_baseline,
        CASE WHEN event_id % 5 = 0 THEN CAST(2 AS DOUBLE) END AS d2, CAST(0 AS DOUBLE) AS max_stress_baseline, CAST(NULL AS DOUBLE) AS mds_ref FROM {events}),
    questions AS (SELECT DISTINCT user_id AS tenant, s.species FROM {events} JOIN (SELECT 'wheat' AS species, 0 AS k UNION ALL SELECT 'maize', 1) s ON s.k >= 0)"""


@query(f"""WITH {oracle(ASSESSED)}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY assessed_at DESC, assessment_id) AS age FROM assessed) t WHERE age <= 5),
    m AS (SELECT q.tenant, q.species, assessment_id, stage, kc, ky, coalesce(nullif(d1, 0), nullif(nwsb_baseline, 0)) AS d1, coalesce(nullif(d2, 0), nullif(max_stress_baseline, 0)) AS d2, mds_ref,
        row_number() OVER (PARTITION BY q.tenant, q.species ORDER BY CASE WHEN contains(lower(r.species), lower(q.species)) THEN 0 ELSE 1 END, age) AS n FROM questions q JOIN r ON r.tenant = q.tenant)
    SELECT * EXCLUDE (n) FROM m WHERE n = 1 AND (kc IS NOT NULL OR d1 IS NOT NULL OR d2 IS NOT NULL OR mds_ref IS NOT NULL)""")
def assessment_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Parameters from the newest assessments where the reference has none."""
    return K.assessment_fallback(*(bound(spark, d, f"WITH {ASSESSED} SELECT * FROM {n}") for n in ("questions", "assessed")))


FEEDS = """feeds AS (SELECT concat(' cr', CAST(100 + n_nationkey AS STRING)) AS eppo_code, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_nationkey AS DOUBLE) END AS crude_protein_pct,
        CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE CAST(70 AS DOUBLE) END AS organic_matter_digestibility_pct FROM {nation} WHERE n_regionkey < 4),
    pests AS (SELECT DISTINCT concat('CR', CAST(100 + n_nationkey AS STRING)) AS eppo, lower(c_mktsegment) AS pest FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_acctbal > 5000),
    inputs AS (SELECT s_name AS product, CASE WHEN s_suppkey % 2 = 0 THEN 'fungicide' ELSE 'insecticide' END AS category, CASE s_suppkey % 4 WHEN 0 THEN 'Building mites; MACHINERY rust' WHEN 1 THEN 'Household moth' WHEN 2 THEN NULL ELSE 'automobile' END AS target_pests FROM {supplier})"""


@query(f"""WITH {oracle(CATALOG)}, {oracle(FEEDS)} SELECT eppo, crude_protein_pct, organic_matter_digestibility_pct FROM crops JOIN feeds ON upper(trim(eppo_code)) = upper(eppo)
    WHERE crude_protein_pct IS NOT NULL OR organic_matter_digestibility_pct IS NOT NULL""")
def forage_value(spark: SparkSession, d: str) -> DataFrame:
    """Crops that are feeds."""
    return K.forage_value(catalog(spark, d, "crops")[0].select("eppo"), bound(spark, d, f"WITH {FEEDS} SELECT * FROM feeds"))


@query(f"WITH {oracle(FEEDS)} SELECT DISTINCT eppo, product, category FROM pests JOIN inputs ON contains(lower(coalesce(target_pests, '')), pest)")
def organic_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Permitted products against a crop's pests."""
    return K.organic_inputs(*(bound(spark, d, f"WITH {FEEDS} SELECT * FROM {n}") for n in ("pests", "inputs")))


PRODUCTS = """products AS (SELECT event_id AS product_id, user_id AS parcel_id, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(floor(value) AS DOUBLE) END AS lst,
    CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS DOUBLE) / 128 END AS smi FROM {events})"""


@query(f"""WITH {oracle(PRODUCTS)}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY day DESC, product_id) AS n FROM products) t WHERE n <= 200)
    SELECT parcel_id, coalesce(string_agg(CAST(CAST(lst AS INT) AS STRING), ',' ORDER BY day, product_id), '') AS lst, count(lst) AS lst_count, arg_max(lst, (day, product_id)) FILTER (lst IS NOT NULL) AS lst_current,
        count(smi) AS smi_count, arg_max(smi, (day, product_id)) FILTER (smi IS NOT NULL) AS smi_current FROM p GROUP BY parcel_id""")
def climate_series(spark: SparkSession, d: str) -> DataFrame:
    """Two sorted series of a parcel with their latest values."""
    rows = K.observation_series(bound(spark, d, f"WITH {PRODUCTS} SELECT * FROM products"), "parcel_id", {"lst": "lst", "smi": "smi"})
    return rows.withColumn("lst", F.array_join(F.transform("lst", lambda x: x.cast("int").cast("string")), ",")).drop("smi")


PLACES = """parcels AS (SELECT c_custkey AS parcel_id, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'no place'
        ELSE concat('[[[ ', CAST(-180 + (c_custkey * 29) % 360 AS STRING), '.25, ', CAST(-60 + (c_custkey * 17) % 120 AS STRING), '.125], [0, 0]]]') END AS location,
        CASE WHEN c_custkey % 5 = 0 THEN 'big' ELSE CAST(c_custkey % 40 AS STRING) END AS area, CASE c_custkey % 4 WHEN 0 THEN ' Drip ' WHEN 1 THEN 'none' END AS irrigation_system,
        CASE c_custkey % 3 WHEN 0 THEN 'Regadío' WHEN 1 THEN 'secano' END AS irrigation_regime FROM {customer}),
    places AS (SELECT s_suppkey AS site_id, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE r_name END AS climate_class, CAST(-60 + (s_suppkey * 17) % 120 AS DOUBLE) AS latitude, CAST(-180 + (s_suppkey * 29) % 360 AS DOUBLE) AS longitude
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey)"""


@query(f"""WITH {oracle(PLACES)}, p AS (SELECT parcel_id, TRY_CAST(nullif(regexp_extract(coalesce(location, ''), '\\[\\s*(-?[0-9.]+)\\s*,\\s*(-?[0-9.]+)', 2), '') AS DOUBLE) AS lat,
        TRY_CAST(nullif(regexp_extract(coalesce(location, ''), '\\[\\s*(-?[0-9.]+)\\s*,\\s*(-?[0-9.]+)', 1), '') AS DOUBLE) AS lon, TRY_CAST(area AS DOUBLE) AS area_ha,
        CASE WHEN trim(irrigation_system) <> '' THEN CASE WHEN regexp_matches(lower(irrigation_system), 'drip|sprinkler|flood|pivot|irrigat') THEN 'irrigated' ELSE 'rainfed' END
             WHEN trim(irrigation_regime) <> '' THEN CASE WHEN regexp_matches(lower(irrigation_regime), 'regad|irrig') THEN 'irrigated' ELSE 'rainfed' END END AS irrigation,
        CASE WHEN trim(irrigation_system) <> '' THEN 'system' WHEN trim(irrigation_regime) <> '' THEN 'regime' ELSE 'unknown' END AS irrigation_source FROM parcels),
    n AS (SELECT parcel_id, climate_class, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(latitude) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin((radians(longitude) - radians(lon)) / 2), 2))), 3) AS site_km, site_id
        FROM p JOIN places ON climate_class IS NOT NULL),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY site_km, site_id) AS r FROM n WHERE site_km <= 50) t WHERE r = 1)
    SELECT p.*, f.climate_class, site_km FROM p LEFT JOIN f ON f.parcel_id = p.parcel_id""")
def parcel_environment(spark: SparkSession, d: str) -> DataFrame:
    """Place, irrigation and climate of parcels before a crop is assigned."""
    return K.parcel_environment(*(bound(spark, d, f"WITH {PLACES} SELECT * FROM {n}") for n in ("parcels", "places")))


POOL = """pool AS (SELECT a.n_name AS previous, upper(b.n_name) AS eppo, CASE WHEN b.n_nationkey % 2 = 0 THEN concat('Crop ', b.n_name) END AS name FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey),
    advised AS (SELECT a.n_name AS previous, CASE WHEN b.n_nationkey % 3 = 0 THEN lower(concat('crop ', b.n_name)) END AS name, CASE WHEN b.n_nationkey % 5 = 0 THEN b.n_name ELSE '' END AS scientific_name,
        CASE WHEN b.n_nationkey % 7 = 0 THEN lower(b.n_name) END AS eppo_code FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey)"""


@query(f"""WITH {oracle(POOL)} SELECT DISTINCT previous, eppo, name FROM pool p WHERE eppo <> previous AND EXISTS (SELECT 1 FROM advised a WHERE a.previous = p.previous
    AND (lower(coalesce(p.name, p.eppo)) IN (lower(a.name), lower(nullif(a.scientific_name, '')), lower(a.eppo_code)) OR lower(p.eppo) IN (lower(a.name), lower(nullif(a.scientific_name, '')), lower(a.eppo_code))))""")
def successor_crops(spark: SparkSession, d: str) -> DataFrame:
    """Crops of a pool that any name of a recommended successor names."""
    return K.successors(*(bound(spark, d, f"WITH {POOL} SELECT * FROM {n}") for n in ("pool", "advised")))
