"""Queries over parcels: rankings for many targets, soil by depth, context, plan lifecycles and catalogue feeds, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import changes as G
from harrow.operators import lifecycle as L
from harrow.operators import nearby as N
from harrow.operators import rotations as R
from harrow.operators import soils as S
from harrow.operators import varieties as V
from harrow.operators.asof import crop_context as context
from harrow.plans.queries import DOMAIN, NOW, USABLE
from harrow.plans.registry import oracle, plain, query
from harrow.sources.publish import Gate, Versions
from harrow.sources.scratch import shared_folder
from harrow.sources.tables import trial_links, trial_sites, variety_trials

PARCEL = """SELECT c_custkey AS target_id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(250 + (c_custkey * 41) % 1000 AS DOUBLE) END AS rainfall,
    CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(600 + (c_custkey * 59) % 900 AS DOUBLE) END AS et0, CAST((c_custkey * 11) % 100 AS DOUBLE) AS frost,
    CAST((c_custkey * 137) % 2000 AS DOUBLE) AS elevation, r_name AS climate_class,
    CASE c_custkey % 6 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LARGE' WHEN 4 THEN 'PROMO' ELSE 'ECONOMY' END AS crop
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
NEAR_MANY = f"""{DOMAIN}, parcel AS ({oracle(PARCEL)}),
    pf AS (SELECT *, CASE WHEN rainfall IS NOT NULL AND coalesce(et0, 0) <> 0 AND frost IS NOT NULL AND elevation IS NOT NULL THEN rainfall / et0 END AS arid FROM parcel),
    sf AS (SELECT *, CASE WHEN rainfall IS NOT NULL AND coalesce(et0, 0) <> 0 THEN rainfall / CAST(et0 AS DOUBLE) END AS arid FROM trial_site),
    b AS (SELECT min(arid) AS la, max(arid) AS ha, min(rainfall) AS lr, max(rainfall) AS hr, min(frost_days) AS lf, max(frost_days) AS hf, min(elevation) AS le, max(elevation) AS he FROM sf WHERE arid IS NOT NULL),
    pairs AS (SELECT target_id, crop, s.site_id, s.name, p.arid IS NOT NULL AND s.arid IS NOT NULL AS measured,
        p.climate_class = s.climate_class AND abs(s.rainfall - p.rainfall) <= 200 AS alike, p.arid IS NOT NULL AS known,
        round(sqrt((2 * pow((s.arid - p.arid) / (greatest(ha, p.arid) - least(la, p.arid)), 2) + pow((s.rainfall - p.rainfall) / (greatest(hr, p.rainfall) - least(lr, p.rainfall)), 2)
            + pow((s.frost_days - p.frost) / (greatest(hf, p.frost) - least(lf, p.frost)), 2) + 0.5 * pow((s.elevation - p.elevation) / (greatest(he, p.elevation) - least(le, p.elevation)), 2)) / 4.5), 4) AS d
        FROM pf p, sf s, b),
    near AS (SELECT target_id, crop, site_id, name, CASE WHEN measured THEN d WHEN known THEN 2.0 END AS distance,
        row_number() OVER (PARTITION BY target_id ORDER BY CASE WHEN measured THEN d WHEN known THEN 2.0 END NULLS FIRST, name, site_id) AS rank FROM pairs WHERE measured OR alike)"""


def _parcels(spark: SparkSession, d: str) -> DataFrame:
    return plain(spark, d, PARCEL.replace("{", "").replace("}", ""))


@query(f"{NEAR_MANY} SELECT target_id, site_id, distance, rank FROM near WHERE rank <= 10")
def nearest_sites_of_parcels(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest sites of every parcel, by features or by class and rainfall."""
    return N.nearest_sites(_parcels(spark, d), trial_sites(spark, d), k=10).select("target_id", "site_id", "distance", "rank")


@query(f"""{NEAR_MANY}, t AS (SELECT DISTINCT trial_id, crop, variety_norm, year, yield_kg_ha, note FROM variety_trial WHERE {USABLE}),
    m AS (SELECT target_id, t.crop, variety_norm, t.trial_id, year, yield_kg_ha, note, max(coalesce(1.0 / (1.0 + distance), 1.0)) AS ws
        FROM near n JOIN trial_at l ON l.site_id = n.site_id JOIN t ON t.trial_id = l.trial_id AND t.crop = n.crop WHERE n.rank <= 10 GROUP BY ALL),
    w AS (SELECT *, ws * CASE WHEN {NOW} - year > 0 THEN pow(0.5, ({NOW} - year) / 8.0) ELSE 1.0 END AS w FROM m),
    v AS (SELECT target_id, crop, variety_norm AS variety, round(round(sum(w * yield_kg_ha) / nullif(sum(CASE WHEN yield_kg_ha IS NOT NULL THEN w END), 0), 6), 1) AS mean_yield,
        min(yield_kg_ha) AS min_yield, max(yield_kg_ha) AS max_yield, count(yield_kg_ha) AS yield_count, count(*) AS trial_count, max(note) AS rust, max(year % 5) AS mildew FROM w GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY target_id, crop ORDER BY mean_yield DESC NULLS LAST, variety) AS rank FROM v)
    SELECT target_id, crop, rank, variety, mean_yield, min_yield, max_yield, yield_count, trial_count, CAST(rust AS INT) AS rust, CAST(mildew AS INT) AS mildew FROM r WHERE rank <= 5""")
def extrapolate_for_parcels(spark: SparkSession, d: str) -> DataFrame:
    """The five best varieties of every parcel's crop, with the highest scores of their diseases."""
    trials = variety_trials(spark, d)
    scores = F.create_map(F.lit("rust"), F.col("note").cast("double"), F.lit("mildew"), (F.col("year") % 5).cast("double"))
    scored = V.usable(trials).withColumn("scores", F.map_filter(scores, lambda _, v: v.isNotNull()))
    parcels = _parcels(spark, d)
    near = N.nearest_sites(parcels, trial_sites(spark, d), k=10)
    ranked = N.rank_for_targets(parcels.select("target_id", "crop"), near, scored, trial_links(trials), NOW, top_n=5)
    of = lambda name: F.col("scores")[name].cast("int").alias(name)
    return ranked.select("target_id", "crop", "rank", "variety", "mean_yield", "min_yield", "max_yield", "yield_count", "trial_count", of("rust"), of("mildew"))


HORIZON = """SELECT l_suppkey AS parcel_id, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_linenumber * 20 - 20 AS DOUBLE) END AS depth_from,
    CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_linenumber * 20 - 15 + CAST(l_quantity AS INT) % 30 AS DOUBLE) END AS depth_to,
    CASE WHEN l_linenumber = 4 THEN -9999.0 ELSE 4.5 + l_quantity / 20 END AS ph, l_discount * 20 AS organic_carbon,
    0.2 + l_tax AS field_capacity, CASE WHEN l_returnflag = 'N' THEN NULL ELSE 0.1 END AS wilting_point FROM lineitem"""
RANGE = "SELECT s_suppkey AS parcel_id, top, bottom FROM supplier CROSS JOIN (SELECT 0 AS top, 30 AS bottom UNION ALL SELECT 30, 60 UNION ALL SELECT 60, 100 UNION ALL SELECT 130, 200 UNION ALL SELECT 50, 50) AS r"


@query(f"""WITH h AS ({HORIZON}), r AS ({RANGE}),
    m AS (SELECT r.*, nullif(ph, -9999.0) AS ph, organic_carbon, greatest(coalesce(depth_from, 0), top) AS lo, least(depth_to, bottom) AS hi
        FROM r JOIN h ON h.parcel_id = r.parcel_id AND coalesce(depth_from, 0) < bottom AND depth_to > top AND top < bottom WHERE depth_to > coalesce(depth_from, 0)),
    a AS (SELECT parcel_id, top, bottom, sum(ph * (hi - lo)) / sum(CASE WHEN ph IS NOT NULL THEN hi - lo END) AS ph, sum(organic_carbon * (hi - lo)) / sum(hi - lo) AS oc FROM m GROUP BY ALL),
    p AS (SELECT *, max(hi) OVER (PARTITION BY parcel_id, top ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (SELECT DISTINCT parcel_id, top, bottom, lo, hi FROM m) x),
    c AS (SELECT parcel_id, top, bottom, sum(greatest(0, hi - greatest(lo, coalesce(prior, lo)))) AS covered FROM p GROUP BY ALL)
    SELECT r.parcel_id, r.top, r.bottom, round(a.ph, 4) AS ph, round(oc, 4) AS organic_carbon, coalesce(covered, 0.0) AS covered
    FROM r LEFT JOIN a ON a.parcel_id = r.parcel_id AND a.top = r.top AND a.bottom = r.bottom LEFT JOIN c ON c.parcel_id = r.parcel_id AND c.top = r.top AND c.bottom = r.bottom""")
def soil_by_depth(spark: SparkSession, d: str) -> DataFrame:
    """Acidity and carbon of depth ranges from horizons with gaps, overlaps and missing bounds."""
    rows = S.range_means(plain(spark, d, HORIZON), plain(spark, d, RANGE), ["ph", "organic_carbon"])
    return rows.select("parcel_id", "top", "bottom", F.round("ph", 4).alias("ph"), F.round("organic_carbon", 4).alias("organic_carbon"), "covered")


@query(f"""WITH h AS ({HORIZON}) SELECT parcel_id, CASE WHEN sum(coalesce((field_capacity - wilting_point) * (depth_to - coalesce(depth_from, 0)) * 10, 0)) > 0
    THEN round(sum(coalesce((field_capacity - wilting_point) * (depth_to - coalesce(depth_from, 0)) * 10, 0)), 1) END AS awc_mm FROM h GROUP BY parcel_id""")
def available_water(spark: SparkSession, d: str) -> DataFrame:
    """Available water summed over all horizons."""
    return S.available_water(plain(spark, d, HORIZON))


MOMENT = """SELECT o_orderkey AS moment_id, o_custkey AS parcel_id, CASE o_custkey % 6 WHEN 5 THEN 'NONE' ELSE r_name END AS species, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS variety,
    CASE WHEN o_orderstatus = 'O' THEN 'irrigated' END AS management, o_orderdate AS ts FROM orders LEFT JOIN region ON r_regionkey = o_custkey % 6"""
ASSESSMENT = """SELECT max(l_orderkey * 10 + l_linenumber) AS assessment_id, o_custkey AS parcel_id, CASE o_custkey % 6 WHEN 5 THEN 'NONE' ELSE r_name END AS species, l_shipdate AS ts,
    max(CASE WHEN l_linenumber IN (3, 7) THEN NULL ELSE 4.5 + l_quantity / 20 END) AS ph, max(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax * 10 END) AS ec,
    max(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 100 END) AS moisture, CAST(NULL AS DOUBLE) AS temperature
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN region ON r_regionkey = o_custkey % 6 GROUP BY o_custkey, r_name, l_shipdate"""
CROP_FIGURES = "SELECT r_name AS species, 30.0 + r_regionkey AS heat_c, CASE WHEN r_regionkey = 4 THEN NULL ELSE -1.0 * r_regionkey END AS frost_c FROM region"


@query(f"""WITH m AS ({MOMENT}), a AS ({ASSESSMENT}), c AS ({CROP_FIGURES}),
    u AS (SELECT parcel_id, species, ts, max(assessment_id) AS assessment_id FROM a GROUP BY ALL),
    j AS (SELECT m.*, u.assessment_id, u.ts AS told FROM m ASOF LEFT JOIN u ON m.parcel_id = u.parcel_id AND m.species = u.species AND m.ts > u.ts)
    SELECT j.parcel_id, j.species, j.ts, variety, management, heat_c, frost_c, CASE WHEN c.species IS NULL THEN 'default' WHEN variety IS NOT NULL AND management IS NOT NULL THEN concat('variety:', variety, ':management:', management)
            WHEN variety IS NOT NULL THEN concat('variety:', variety) ELSE concat('species:', j.species) END AS source,
        coalesce(ph, ec, moisture, temperature) IS NOT NULL AS sensors_available, CASE WHEN coalesce(ph, ec, moisture, temperature) IS NOT NULL THEN a.ts END AS last_reading, ph, ec, moisture, temperature
    FROM j LEFT JOIN a ON a.assessment_id = j.assessment_id AND a.ts = told LEFT JOIN c ON c.species = j.species""")
def crop_context(spark: SparkSession, d: str) -> DataFrame:
    """Each parcel's crop figures and its last soil assessment before each moment."""
    return context(plain(spark, d, MOMENT), plain(spark, d, ASSESSMENT), plain(spark, d, CROP_FIGURES))


PLAN_EVENT = """SELECT user_id AS parcel_id, concat('m', CAST(month(ts) AS STRING)) AS season, CAST(event_id % 4 AS INT) AS seq, event_id, ts,
    CASE WHEN (event_id * 7) % 20 < 8 THEN 'plan' WHEN (event_id * 7) % 20 < 15 THEN 'advance' WHEN (event_id * 7) % 20 < 17 THEN 'finish' WHEN (event_id * 7) % 20 < 19 THEN 'clear' ELSE 'graft' END AS action,
    CASE event_type WHEN 'click' THEN 'harvest' WHEN 'view' THEN 'grazing' END AS method FROM events"""
PLAN_SQL = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY parcel_id, season ORDER BY ts, event_id) AS n FROM ({PLAN_EVENT}) t),
    run AS (
        SELECT DISTINCT parcel_id, season, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS INT) AS seq, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS reason,
            CAST(MAP {{}} AS MAP(INT, STRUCT(status VARCHAR, method VARCHAR, planted TIMESTAMP, ended TIMESTAMP))) AS st FROM e
        UNION ALL
        SELECT parcel_id, season, n, event_id, seq, action,
            CASE WHEN legal THEN NULL WHEN action = 'graft' THEN 'unknown action' ELSE concat('segment is ', coalesce(own.status, 'missing')) END,
            CASE WHEN NOT legal THEN st
                WHEN action = 'plan' THEN map_concat(st, MAP {{seq: {{'status': 'planned', 'method': method, 'planted': CAST(NULL AS TIMESTAMP), 'ended': CAST(NULL AS TIMESTAMP)}}}})
                WHEN action = 'clear' THEN map_concat(st, MAP {{seq: {{'status': 'cleared', 'method': own.method, 'planted': own.planted, 'ended': own.ended}}}})
                WHEN action = 'finish' THEN map_concat(st, MAP {{seq: {{'status': CASE WHEN own.method = 'harvest' THEN 'harvested' ELSE 'terminated' END, 'method': own.method, 'planted': own.planted, 'ended': ts}}}})
                ELSE map_concat(map_from_entries(list_transform(map_entries(st), lambda x: {{'key': x.key, 'value': CASE WHEN x.value.status = 'active'
                        THEN {{'status': CASE WHEN x.value.method = 'harvest' THEN 'harvested' ELSE 'terminated' END, 'method': x.value.method, 'planted': x.value.planted, 'ended': ts}} ELSE x.value END}})),
                    MAP {{seq: {{'status': 'active', 'method': own.method, 'planted': ts, 'ended': own.ended}}}}) END
        FROM (SELECT *, coalesce(CASE action WHEN 'plan' THEN coalesce(own.status, 'cleared') IN ('planned', 'cleared') WHEN 'advance' THEN own.status IN ('planned', 'active')
                    WHEN 'finish' THEN own.status = 'active' WHEN 'clear' THEN own.status = 'planned' END, FALSE) AS legal
              FROM (SELECT e.*, r.st, r.st[e.seq] AS own FROM run r JOIN e ON e.parcel_id = r.parcel_id AND e.season = r.season AND e.n = r.n + 1) x) y),
    last AS (SELECT parcel_id, season, unnest(map_entries(st)) AS s FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id, season ORDER BY n DESC) AS back FROM run) t WHERE back = 1)
    SELECT 'segment' AS kind, parcel_id, season, s.key AS seq, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS reason,
        s.value.status AS status, s.value.method AS method, s.value.planted AS planted, s.value.ended AS ended FROM last
    UNION ALL SELECT 'refused', parcel_id, season, seq, event_id, action, reason, NULL, NULL, NULL, NULL FROM run WHERE reason IS NOT NULL"""


@query(PLAN_SQL.replace("AS STRING", "AS VARCHAR"))
def plan_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Where each segment of a plan stands after all events, and the moves that were refused."""
    return L.plan_outcomes(plain(spark, d, PLAN_EVENT))


def _snapshot(first: str, last: str) -> str:
    return f"""SELECT p_partkey AS uri, max(p_name) AS name, CAST(max(l_linenumber) AS DOUBLE) AS kc_ini, CASE WHEN min(l_returnflag) = 'A' THEN max(l_tax) END AS heat_c
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '{first}' AND l_shipdate < TIMESTAMP '{last}' GROUP BY p_partkey"""


OLD, NEW = _snapshot("1998-01-01", "1998-04-01"), _snapshot("1998-04-01", "1998-07-01")


@query(f"""WITH a AS ({OLD}), b AS ({NEW}) SELECT coalesce(a.uri, b.uri) AS uri,
    CASE WHEN a.uri IS NULL THEN 'insert' WHEN b.uri IS NULL THEN 'delete' WHEN a.name IS NOT DISTINCT FROM b.name AND a.kc_ini IS NOT DISTINCT FROM b.kc_ini AND a.heat_c IS NOT DISTINCT FROM b.heat_c THEN 'same' ELSE 'update' END AS kind,
    b.name, b.kc_ini, b.heat_c FROM a FULL JOIN b ON a.uri = b.uri""")
def catalogue_changes(spark: SparkSession, d: str) -> DataFrame:
    """H7: what differs between a crop catalogue of one quarter and of the next."""
    return G.changes(plain(spark, d, OLD), plain(spark, d, NEW), ["uri"], 2, unchanged=True).select("uri", "kind", "row.*")


@query(f"""WITH a AS ({OLD}), b AS ({NEW}) SELECT coalesce(a.uri, b.uri) AS uri, b.uri IS NULL AS deleted, b.name, b.kc_ini, b.heat_c,
    CAST(CASE WHEN b.name IS NOT DISTINCT FROM a.name AND b.kc_ini IS NOT DISTINCT FROM a.kc_ini AND b.heat_c IS NOT DISTINCT FROM a.heat_c THEN 1 ELSE 2 END AS BIGINT) AS version FROM a FULL JOIN b ON a.uri = b.uri""")
def catalogue_after_feed(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with tombstones after both feeds, the second of which comes first, and again later."""
    old, new = plain(spark, d, OLD), plain(spark, d, NEW)
    first, second = G.changes(old.limit(0), old, ["uri"], 1), G.changes(old, new, ["uri"], 2)
    empty = first.select("uri", "row", F.lit(False).alias("deleted"), "version").limit(0)
    after = G.applied(G.applied(G.applied(empty, second, ["uri"]), first, ["uri"]), second, ["uri"])
    return after.select("uri", "deleted", "row.*", "version")


#: What a zone offers, from its mean yields y (zone, crop, yield).
FIGURES_OF_YIELDS = """SELECT zone, crop, yield * CASE crop WHEN 'PROMO' THEN 0.22 WHEN 'SMALL' THEN 0.12 ELSE 0.09 END AS protein, CASE crop WHEN 'LARGE' THEN 3.1 WHEN 'STANDARD' THEN 2.4 ELSE 1.7 END AS carbon,
        CASE crop WHEN 'PROMO' THEN 80.0 WHEN 'MEDIUM' THEN 25.0 ELSE 0.0 END AS n_fixation, yield * CASE crop WHEN 'ECONOMY' THEN 0.31 WHEN 'LARGE' THEN 0.26 ELSE 0.2 END - 420.0 AS margin, yield, yield / 40 AS n_requirement FROM y"""
ZONE_FIGURES = f"""{DOMAIN}, y AS (SELECT climate_class AS zone, crop, round(avg(yield_kg_ha), 1) AS yield FROM (SELECT DISTINCT s.climate_class, v.crop, v.trial_id, v.yield_kg_ha
        FROM variety_trial v JOIN trial_at l ON v.trial_id = l.trial_id JOIN trial_site s ON s.site_id = l.site_id WHERE v.yield_kg_ha IS NOT NULL AND NOT v.derived) t GROUP BY climate_class, crop)
    {FIGURES_OF_YIELDS}"""
ZONE_PARCEL = "SELECT c_custkey AS parcel_id, r_name AS zone, CASE c_custkey % 7 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LARGE' WHEN 4 THEN 'PROMO' WHEN 5 THEN 'FALLOW' END AS previous, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 12.5 END AS cover_n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
LOCKED = "SELECT c_custkey AS parcel_id, 2 AS year_no, 'SMALL' AS crop FROM customer WHERE c_mktsegment = 'BUILDING'"
FOLLOWS = [("STANDARD", "PROMO"), ("STANDARD", "SMALL"), ("STANDARD", "LARGE"), ("SMALL", "MEDIUM"), ("SMALL", "STANDARD"), ("MEDIUM", "LARGE"), ("MEDIUM", "ECONOMY"), ("LARGE", "PROMO"), ("LARGE", "SMALL"), ("PROMO", "STANDARD"), ("PROMO", "ECONOMY")]
PRIORITIES = [(1, 3.0, 1.0, 1.0, 2.0, 3.0), (3, 0.0, 2.0, 6.0, 1.0, 1.0)]


def _greedy_sql() -> str:
    follows = ", ".join(f"('{a}', '{b}')" for a, b in FOLLOWS)
    weights = ", ".join(f"({y}, " + ", ".join(repr(w / sum(row) * 100) for w in row) + ")" for y, row in ((y, next((r[1:] for r in PRIORITIES if r[0] == y), PRIORITIES[0][1:])) for y in range(1, 5)))
    sql = f"""WITH fig AS ({ZONE_FIGURES}), parcel AS ({ZONE_PARCEL}), follows(previous, crop) AS (VALUES {follows}), weight(year_no, w1, w2, w3, w4, w5) AS (VALUES {weights}), lock AS ({LOCKED}),
    prior AS (SELECT zone, previous FROM parcel UNION SELECT zone, crop FROM fig),
    named AS (SELECT p.zone, p.previous, f.* EXCLUDE (zone), fo.crop IS NOT NULL AS named, max(CASE WHEN fo.crop IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.zone, p.previous) = 1 AS any_named
        FROM prior p JOIN fig f ON f.zone = p.zone AND f.crop IS DISTINCT FROM p.previous LEFT JOIN follows fo ON fo.previous = p.previous AND fo.crop = f.crop),
    share AS (SELECT zone, previous, crop, n_fixation, n_requirement, {', '.join(f"CASE WHEN {d} > 0 THEN {d} / max({d}) OVER w ELSE 0.0 END AS s{i}" for i, d in enumerate(R.DIMENSIONS, 1))} FROM named WHERE named OR NOT any_named WINDOW w AS (PARTITION BY zone, previous)),
    arc AS (SELECT zone, previous, year_no, crop, n_fixation, n_requirement, round({' + '.join(f"w{i} * s{i}" for i in range(1, 6))}, 1) AS gain FROM share, weight),
    y0 AS (SELECT parcel_id, zone, coalesce(cover_n, 0) AS cover_n, previous, CAST([] AS VARCHAR[]) AS crops, CAST([] AS DOUBLE[]) AS scores, 50.0::DOUBLE AS soil_n FROM parcel)"""
    for y in range(1, 5):
        sql += f""",
    y{y} AS (SELECT parcel_id, zone, cover_n, crop AS previous, list_append(crops, crop) AS crops, list_append(scores, gain) AS scores, round(greatest(0, soil_n + n_fixation - n_requirement) + cover_n, 3) AS soil_n
        FROM (SELECT p.*, a.crop, a.gain, a.n_fixation, a.n_requirement, row_number() OVER (PARTITION BY p.parcel_id ORDER BY a.gain DESC, a.crop) AS r FROM y{y - 1} p JOIN arc a ON a.zone = p.zone AND a.previous IS NOT DISTINCT FROM p.previous AND a.year_no = {y}
                WHERE p.parcel_id NOT IN (SELECT parcel_id FROM lock WHERE year_no = {y})
              UNION ALL SELECT p.*, l.crop, 0.0, f.n_fixation, f.n_requirement, 1 FROM y{y - 1} p JOIN lock l ON l.parcel_id = p.parcel_id AND l.year_no = {y} JOIN fig f ON f.zone = p.zone AND f.crop = l.crop) t WHERE r = 1)"""
    return sql + " SELECT parcel_id, array_to_string(crops, ',') AS crops, round(list_sum(scores), 1) AS score, round(soil_n, 2) AS soil_n FROM y4"


def _rotations(spark: SparkSession, d: str, **how: float) -> DataFrame:
    crops = "previous string, crop string"
    weights = spark.createDataFrame(PRIORITIES, "year_no int, " + ", ".join(f"{x} double" for x in R.DIMENSIONS))
    trials = variety_trials(spark, d)
    measured = trials.where("yield_kg_ha IS NOT NULL AND NOT derived").select("trial_id", "crop", "yield_kg_ha")
    placed = V.in_zones(measured, trial_links(trials), trial_sites(spark, d).select("site_id", F.col("climate_class").alias("zone")))
    yields = placed.groupBy("zone", "crop").agg(F.round(F.avg("yield_kg_ha"), 1).alias("yield"))
    figures = R.written(spark.sql(FIGURES_OF_YIELDS.replace("FROM y", "FROM {y}"), y=yields), "zone-figures")
    return R.best_rotations(plain(spark, d, ZONE_PARCEL), figures, spark.createDataFrame(FOLLOWS, crops), weights, plain(spark, d, LOCKED), **how)


@query(_greedy_sql())
def rotation_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Each year the best allowed crop by that year's weights, with locked years and cover crops, over four years."""
    rows = _rotations(spark, d)
    return rows.select("parcel_id", F.array_join("crops", ",").alias("crops"), F.round("score", 1).alias("score"), F.round("soil_n", 2).alias("soil_n"))


@query()
def rotation_search(spark: SparkSession, d: str) -> DataFrame:
    """The best four years that a search over states finds, if a lack of nitrogen costs and a crop returns after two years at the earliest."""
    rows = _rotations(spark, d, beam=200, gap=2, shortage_cost=0.5)
    return rows.select("parcel_id", F.array_join("crops", ",").alias("crops"), F.round("score", 3).alias("score"), F.round("soil_n", 2).alias("soil_n"))


GATES = [
    ("rows", "count(*)", "new >= 0.5 * old"), ("repeated keys", "count(*) - count(DISTINCT uri)", "new = 0"), ("known thresholds", "count(heat_c) / count(*)", "new >= 0.9 * old"),
    ("coefficients", "max(kc_ini)", "new BETWEEN 0 AND 7"), ("names lost", "count(*) - count(name)", "new <= old"),
]


@query(f"WITH a AS ({OLD}), b AS ({NEW}), m AS (" + " UNION ALL ".join(f"SELECT '{n}' AS gate, (SELECT CAST({m} AS DOUBLE) FROM a) AS old, (SELECT CAST({m} AS DOUBLE) FROM b) AS new" for n, m, _ in GATES) + ")"
       " SELECT gate, old, new, CASE gate " + " ".join(f"WHEN '{n}' THEN {r}" for n, _, r in GATES) + " END AS passed FROM m")  # fmt: skip
def reingest_gates(spark: SparkSession, d: str) -> DataFrame:
    """A quarter's catalogue held against the published one of the quarter before."""
    versions = Versions(spark, f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}")
    versions.publish(plain(spark, d, OLD), [])
    return versions.report(plain(spark, d, NEW), [Gate(n, m, r) for n, m, r in GATES])
