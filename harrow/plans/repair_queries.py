"""Queries over back-fills, identities and checks, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import backfills as B
from harrow.plans.registry import bound, oracle, query


def rows_of(spark: SparkSession, d: str, views: str, *names: str) -> list[DataFrame]:
    return [bound(spark, d, f"WITH {views} SELECT * FROM {n}") for n in names]


PAIRS = """stored AS (SELECT a.n_name AS crop_a, b.n_name AS crop_b, CASE (a.n_nationkey + b.n_nationkey) % 3 WHEN 0 THEN 'benefit' WHEN 1 THEN 'restriction' END AS effect
        FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey <> b.n_nationkey),
    truth AS (SELECT a.n_name AS crop_a, b.n_name AS crop_b, CASE (a.n_nationkey * b.n_nationkey) % 2 WHEN 0 THEN 'benefit' ELSE 'restriction' END AS effect
        FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey)"""


@query(f"""WITH {oracle(PAIRS)} SELECT s.crop_a, s.crop_b, coalesce(t.effect, s.effect) AS effect, CASE WHEN t.effect IS NULL THEN 'unknown' WHEN s.effect IS NOT DISTINCT FROM t.effect THEN 'already' ELSE 'written' END AS status
    FROM stored s LEFT JOIN truth t ON t.crop_a = s.crop_a AND t.crop_b = s.crop_b""")
def rotation_effect_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Stored rotation effects reconciled with the truth."""
    return B.reconcile_effects(*rows_of(spark, d, PAIRS, "stored", "truth"))


TAGGED = """tagged AS (SELECT l_orderkey, l_linenumber, l_partkey, concat(p_mfgr, ' ', p_brand) AS source_name, p_type AS crop_group, CASE WHEN l_tax > 0.06 THEN 'organic' END AS management
    FROM (SELECT *, CASE WHEN p_size % 4 = 0 THEN 'Alpha Trials' WHEN p_size % 4 = 1 THEN 'Beta Institute' ELSE 'Gamma' END AS p_mfgr FROM {part}) p JOIN {lineitem} ON l_partkey = p_partkey)"""
MANAGEMENT_RULES = [("Alpha", None, "conventional"), ("Beta", "PROMO", "organic"), ("Beta", None, "mixed")]


@query(f"""WITH {oracle(TAGGED)}, t AS (SELECT l_orderkey, l_linenumber, crop_group, source_name, coalesce(management, CASE WHEN contains(source_name, 'Alpha') THEN 'conventional' WHEN contains(source_name, 'Beta') AND contains(crop_group, 'PROMO') THEN 'organic'
        WHEN contains(source_name, 'Beta') THEN 'mixed' ELSE 'conventional' END) AS management FROM tagged) SELECT l_orderkey, l_linenumber, crop_group, source_name, management FROM t""")
def management_tags(spark: SparkSession, d: str) -> DataFrame:
    """Management of each trial by ordered source rules."""
    rows = B.tag_management(rows_of(spark, d, TAGGED, "tagged")[0], MANAGEMENT_RULES)
    return rows.select("l_orderkey", "l_linenumber", "crop_group", "source_name", "management")


TITLES = """titled AS (SELECT p_partkey AS param_id, CASE WHEN p_size % 10 = 0 THEN NULL ELSE concat(CASE p_size % 6 WHEN 0 THEN 'Wine and GRAPE' WHEN 1 THEN 'Wheat of' WHEN 2 THEN 'Chickpea,' WHEN 3 THEN 'Corn' WHEN 4 THEN 'Vicia' ELSE 'On' END, ' ', p_brand) END AS source_short,
        CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS cultivar, CASE p_size % 9 WHEN 0 THEN 'flowering' WHEN 1 THEN 'maturity' WHEN 2 THEN 'booting' ELSE 'other' END AS stage,
        CASE WHEN p_size % 5 = 0 THEN CAST(p_size AS DOUBLE) / 64 END AS ky, CASE WHEN p_size % 8 = 0 THEN p_type END AS doi, CASE p_size % 11 WHEN 0 THEN 'global_standard' WHEN 1 THEN 'odd' END AS explicit FROM {part}),
    held AS (SELECT DISTINCT l_partkey AS param_id FROM {lineitem} WHERE l_quantity > 48)"""


@query(f"""WITH {oracle(TITLES)}, s AS (SELECT param_id, CASE WHEN contains(lower(source_short), 'wheat') THEN 'wheat' WHEN contains(lower(source_short), 'grape') THEN 'wine grapes' WHEN contains(lower(source_short), 'corn') THEN 'maize'
        WHEN contains(lower(source_short), 'chickpea') THEN 'chickpea' WHEN contains(lower(source_short), 'vicia') THEN 'beans' END AS species, coalesce(cultivar, 'generic') AS stage FROM titled WHERE param_id NOT IN (SELECT param_id FROM held))
    SELECT * FROM s WHERE species IS NOT NULL""")
def orphan_params(spark: SparkSession, d: str) -> DataFrame:
    """Parameter sets without a species, placed by the first word their source's title holds."""
    return B.link_orphan_params(*rows_of(spark, d, TITLES, "titled", "held"))


@query(f"""WITH {oracle(TITLES)} SELECT param_id, coalesce(ky, CASE stage WHEN 'flowering' THEN 1.15 WHEN 'maturity' THEN 0.35 WHEN 'booting' THEN 0.80 ELSE 0.45 END) AS ky,
    CASE WHEN explicit = 'global_standard' THEN explicit WHEN upper(trim(coalesce(source_short, ''))) LIKE 'FAO%' OR contains(coalesce(source_short, ''), 'Steduto') THEN 'global_standard' WHEN doi <> '' THEN 'peer_reviewed_study' ELSE 'extension_advisory' END AS kind FROM titled""")
def param_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Missing yield responses by stage, and kinds of sources."""
    rows = B.fill_ky(rows_of(spark, d, TITLES, "titled")[0])
    return rows.select("param_id", "ky", B.source_type(F.col("explicit"), F.col("source_short"), F.col("doi")).alias("kind"))


LIMITS = "limits AS (SELECT p_partkey AS crop_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(30 + p_size % 15 AS DOUBLE) END AS temp_max_abs, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size % 20 - 10 AS DOUBLE) END AS temp_min_abs FROM {part})"


@query(f"""WITH {oracle(LIMITS)}, t AS (SELECT crop_id, temp_max_abs - 2 AS heat_damage_c, CASE WHEN temp_min_abs < 0 THEN temp_min_abs END AS frost_damage_c FROM limits)
    SELECT * FROM t WHERE heat_damage_c IS NOT NULL OR frost_damage_c IS NOT NULL""")
def thermal_limits(spark: SparkSession, d: str) -> DataFrame:
    """Damage thresholds from absolute temperatures."""
    return B.thermal_limits(rows_of(spark, d, LIMITS, "limits")[0])


GEO = """places AS (SELECT s_suppkey AS site_id, CASE WHEN s_suppkey % 6 = 0 THEN concat('Mean of ', n_name) WHEN s_suppkey % 10 = 3 THEN NULL ELSE concat(' ', n_name, ' ') END AS name, CASE WHEN s_suppkey % 4 = 0 THEN CAST(1 AS DOUBLE) END AS latitude,
        CASE WHEN s_suppkey % 4 = 0 THEN CAST(2 AS DOUBLE) END AS longitude, CASE WHEN s_suppkey % 3 = 0 THEN 'old' END AS climate_class FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey),
    gazetteer AS (SELECT n_name AS name, CAST(n_nationkey AS DOUBLE) AS latitude, CAST(n_nationkey * 2 AS DOUBLE) AS longitude, CASE WHEN n_nationkey % 2 = 0 THEN 'new' END AS climate_class FROM {nation} WHERE n_regionkey <> 4)"""


@query(f"""WITH {oracle(GEO)}, t AS (SELECT p.*, g.latitude AS la, g.longitude AS lo, g.climate_class AS cc, CASE WHEN p.latitude IS NOT NULL OR p.name IS NULL THEN 'known' WHEN contains(lower(p.name), 'mean of') THEN 'aggregate' WHEN g.name IS NULL THEN 'not in registry' ELSE 'filled' END AS status
        FROM places p LEFT JOIN gazetteer g ON lower(trim(g.name)) = lower(trim(p.name)))
    SELECT site_id, name, CASE status WHEN 'filled' THEN coalesce(la, latitude) ELSE latitude END AS latitude, CASE status WHEN 'filled' THEN coalesce(lo, longitude) ELSE longitude END AS longitude,
        CASE status WHEN 'filled' THEN coalesce(cc, climate_class) ELSE climate_class END AS climate_class, status FROM t""")
def place_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates from a registry, but not for aggregates."""
    return B.fill_places(*rows_of(spark, d, GEO, "places", "gazetteer"), ["mean of", "national"], ["latitude", "longitude", "climate_class"])


PARTS = """asked AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN concat(' ', n_name) WHEN 1 THEN concat('near ', n_name, ' town') WHEN 2 THEN substring(n_name, 1, 7) WHEN 3 THEN c_mktsegment END AS location FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey),
    known AS (SELECT lower(n_name) AS key, 25 - n_nationkey AS place, n_name AS name, r_name AS country FROM {nation} JOIN {region} ON n_regionkey = r_regionkey)"""


@query(f"""WITH {oracle(PARTS)}, a AS (SELECT id, location, CASE WHEN trim(location) <> '' THEN lower(trim(location)) END AS k FROM asked),
    j AS (SELECT a.*, name, country, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN k = key THEN 0 ELSE 1 END, place) AS r FROM a LEFT JOIN known ON contains(k, key) OR contains(key, k))
    SELECT id, location, name, country FROM j WHERE r = 1""")
def location_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Locations by equal key, else by the first key that holds them or that they hold."""
    return B.lookup_by_part(*rows_of(spark, d, PARTS, "asked", "known"), "location", ["name", "country"])


NATURAL = """trials AS (SELECT l_orderkey, l_linenumber, p_brand AS source, upper(p_type) AS crop, p_name AS variety, l_linestatus AS location, CAST(year(l_shipdate) AS INT) AS year, CASE WHEN l_quantity > 25 THEN 'winter' END AS cycle FROM {lineitem} JOIN {part} ON p_partkey = l_partkey),
    cycles AS (SELECT DISTINCT concat(p_brand, ' ') AS source, lower(p_type) AS crop, p_name AS variety, 'o' AS location, 1995 AS year, 'spring' AS cycle FROM {part} WHERE p_size > 20)"""


@query(f"""WITH {oracle(NATURAL)}, u AS (SELECT lower(trim(source)) AS s, lower(trim(crop)) AS c, lower(trim(variety)) AS v, lower(trim(location)) AS l, year AS y, max(cycle) AS n FROM cycles GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, crop, year, coalesce(n, cycle) AS cycle FROM trials LEFT JOIN u ON s = lower(trim(source)) AND c = lower(trim(crop)) AND v = lower(trim(variety)) AND l = lower(trim(location)) AND y = year""")
def cycle_update(spark: SparkSession, d: str) -> DataFrame:
    """The cycle of each trial by a key of five columns."""
    rows = B.update_by_natural_key(*rows_of(spark, d, NATURAL, "trials", "cycles"), ["source", "crop", "variety", "location", "year"], "cycle")
    return rows.select("l_orderkey", "l_linenumber", "crop", "year", "cycle")


GRAFTS = """grafts AS (SELECT o_orderkey AS trial_id, CASE WHEN o_orderstatus = 'F' THEN concat(' ', o_orderpriority, ' ') WHEN o_orderstatus = 'O' THEN upper(o_orderpriority) END AS rootstock, CASE WHEN o_orderkey % 2 = 0 THEN 'PRNDU' END AS crop_eppo, 'Prunus dulcis' AS crop_scientific FROM {orders}),
    stocks AS (SELECT DISTINCT concat('rootstock|', lower(o_orderpriority), '|', CASE WHEN o_orderstatus = 'F' THEN 'prndu' ELSE 'prunus dulcis' END) AS merge_key, concat(o_orderpriority, o_orderstatus) AS rootstock_id FROM {orders} WHERE o_orderstatus <> 'P')"""


@query(f"""WITH {oracle(GRAFTS)} SELECT DISTINCT trial_id, rootstock_id FROM grafts JOIN stocks ON merge_key = concat('rootstock|', lower(trim(rootstock)), '|', lower(coalesce(crop_eppo, crop_scientific, ''))) WHERE rootstock IS NOT NULL""")
def rootstock_links(spark: SparkSession, d: str) -> DataFrame:
    """C14: trials linked to rootstocks by a composed key."""
    return B.rootstock_links(*rows_of(spark, d, GRAFTS, "grafts", "stocks"))


ALIASES = """links AS (SELECT DISTINCT l_orderkey AS trial_id, l_suppkey AS site_id FROM {lineitem}), sites AS (SELECT s_suppkey AS site_id FROM {supplier}),
    aliases AS (SELECT s_suppkey AS site_id, CASE WHEN s_acctbal < 0 THEN 1 ELSE s_suppkey END AS survivor_id FROM {supplier}), trials AS (SELECT o_orderkey AS trial_id FROM {orders})"""


@query(f"""WITH {oracle(ALIASES)} SELECT DISTINCT trial_id, survivor_id AS site_id FROM links JOIN aliases USING (site_id)""")
def alias_merge(spark: SparkSession, d: str) -> DataFrame:
    """K8: links after named sites were absorbed."""
    links, sites, aliases = rows_of(spark, d, ALIASES, "links", "sites", "aliases")
    return B.absorb_sites(links, sites, aliases)[0]


@query(f"""WITH {oracle(ALIASES)} SELECT (SELECT count(*) FROM trials) AS trials, (SELECT count(*) FROM sites) AS sites_before, (SELECT count(*) FROM aliases WHERE site_id = survivor_id) AS sites_after,
    (SELECT count(*) FROM trials) - (SELECT count(DISTINCT trial_id) FROM links) AS orphans_before, (SELECT count(*) FROM trials) - (SELECT count(DISTINCT trial_id) FROM links) AS orphans_after""")
def identity_migration(spark: SparkSession, d: str) -> DataFrame:
    """K5: counts before and after sites were merged; no trial may lose its site."""
    links, sites, aliases, trials = rows_of(spark, d, ALIASES, "links", "sites", "aliases", "trials")
    after, left = B.absorb_sites(links, sites, aliases)
    return B.migration_report(links, after, sites, left, trials)


RAW = """raw AS (SELECT l_orderkey * 10 + l_linenumber AS id, concat('SRC', CAST(l_linenumber % 3 AS STRING)) AS source_id, CASE l_partkey % 8 WHEN 0 THEN 'rust' WHEN 1 THEN 'rust_pct' WHEN 2 THEN 'anfaelligkeit_rost' WHEN 3 THEN 'podredumbres_tallo'
        WHEN 4 THEN 'höhe' WHEN 5 THEN 'rust_escala_0_9' WHEN 6 THEN 'lodging_score' ELSE 'unknown_thing' END AS raw_key FROM {lineitem}),
    registered AS (SELECT 'SRC0' AS source_id, 'rust' AS key, 'rust_severity' AS trait UNION ALL SELECT 'SRC0', 'hoehe', 'height' UNION ALL SELECT 'SRC1', 'podredumbre_tallo', 'stem_rot' UNION ALL SELECT 'SRC1', 'rost', 'rust_severity'
        UNION ALL SELECT 'SRC2', 'lodging', 'lodging' UNION ALL SELECT 'SRC2', 'rust', 'rust_severity')"""


@query(f"""WITH {oracle(RAW)}, f AS (SELECT DISTINCT id, source_id, raw_key, CASE raw_key WHEN 'rust' THEN 0 WHEN 'rust_pct' THEN 1 WHEN 'rust_escala_0_9' THEN 4 WHEN 'lodging_score' THEN 7 WHEN 'podredumbres_tallo' THEN 20 WHEN 'anfaelligkeit_rost' THEN 31 WHEN 'höhe' THEN 40 END AS rank,
        CASE raw_key WHEN 'rust' THEN 'rust' WHEN 'rust_pct' THEN 'rust' WHEN 'rust_escala_0_9' THEN 'rust' WHEN 'lodging_score' THEN 'lodging' WHEN 'podredumbres_tallo' THEN 'podredumbre_tallo' WHEN 'anfaelligkeit_rost' THEN 'rost' WHEN 'höhe' THEN 'hoehe' END AS form FROM raw)
    SELECT id, trait, raw_key FROM (SELECT id, trait, raw_key, row_number() OVER (PARTITION BY id, trait ORDER BY rank, raw_key) AS r FROM f JOIN registered g ON g.source_id = f.source_id AND g.key = f.form) t WHERE r = 1""")
def trait_key_match(spark: SparkSession, d: str) -> DataFrame:
    """K2: raw trait keys under their registered traits, by precedence of their forms."""
    return B.match_trait_keys(*rows_of(spark, d, RAW, "raw", "registered"))


CHECKED = """checked AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'eppo:AAA0' WHEN 1 THEN 'bbb1 ' WHEN 2 THEN '' WHEN 3 THEN 'CCC2' END AS crop_eppo, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END AS variety,
        CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 2000 + c_custkey % 20 END AS year, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE n_name END AS location, c_mktsegment AS trait FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey),
    codes AS (SELECT 'AAA0' AS eppo UNION ALL SELECT 'BBB1'), towns AS (SELECT n_name AS name FROM {nation} WHERE n_regionkey < 3), keys AS (SELECT DISTINCT c_mktsegment AS key FROM {customer} WHERE c_mktsegment < 'F')"""


@query(f"""WITH {oracle(CHECKED)}, v AS (SELECT 'crop' AS kind, upper(trim(replace(crop_eppo, 'eppo:', ''))) AS value FROM checked WHERE crop_eppo <> '' UNION ALL SELECT 'location', lower(trim(location)) FROM checked WHERE location IS NOT NULL
        UNION ALL SELECT 'trait', trait FROM checked UNION ALL SELECT 'required', 'crop_eppo' FROM checked WHERE coalesce(trim(crop_eppo), '') = '' UNION ALL SELECT 'required', 'variety' FROM checked WHERE trim(variety) = '' UNION ALL SELECT 'required', 'year' FROM checked WHERE year IS NULL)
    SELECT kind, value, count(*) AS records FROM v WHERE NOT (kind = 'crop' AND value IN (SELECT eppo FROM codes)) AND NOT (kind = 'location' AND value IN (SELECT lower(name) FROM towns)) AND NOT (kind = 'trait' AND value IN (SELECT key FROM keys)) GROUP BY kind, value""")
def source_validation(spark: SparkSession, d: str) -> DataFrame:
    """What a source uses that no registry knows, and missing fields."""
    trials, codes, towns, keys = rows_of(spark, d, CHECKED, "checked", "codes", "towns", "keys")
    return B.unmapped(trials.withColumn("traits", F.create_map("trait", F.lit(1))), codes, towns, keys)


OFFERED = "offered AS (SELECT s_suppkey AS id, n_name AS species, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS author, CASE WHEN s_suppkey % 3 = 0 THEN 'local' END AS cultivar, CASE WHEN s_suppkey % 5 = 0 THEN 'organic' END AS management FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey)"


@query(f"""WITH {oracle(OFFERED)} SELECT id, species, author, coalesce(cultivar, '__contributed__') AS cultivar, coalesce(management, '__contributed__') AS management, '__contributed__' AS climate_zone, FALSE AS is_default,
    concat('Contributed: ', coalesce(author, 'anonymous')) AS source_short, 'pending_review' AS status FROM offered""")
def contributions(spark: SparkSession, d: str) -> DataFrame:
    """Offered parameters, open for review."""
    return B.contributions(rows_of(spark, d, OFFERED, "offered")[0])


CITED = """cited AS (SELECT o_custkey AS page, o_orderkey AS place, CAST(o_custkey % 4 AS STRING) || '-' || o_orderstatus AS source_id FROM {orders}),
    sources AS (SELECT DISTINCT CAST(o_custkey % 3 AS STRING) || '-' || o_orderstatus AS source_id, o_orderstatus AS s FROM {orders})"""


@query(f"""WITH {oracle(CITED)}, t AS (SELECT page, place, CASE s WHEN 'F' THEN 'texto F' WHEN 'O' THEN 'text O' ELSE 'Text P' END AS text FROM cited JOIN sources USING (source_id)),
    u AS (SELECT page, text, min(place) AS place FROM t GROUP BY page, text) SELECT page, string_agg(text, ' ' ORDER BY place) AS text FROM u GROUP BY page""")
def attributions(spark: SparkSession, d: str) -> DataFrame:
    """Attributions of cited sources, in order and once each, with a fallback of the language."""
    cited, sources = rows_of(spark, d, CITED, "cited", "sources")
    m = lambda *kv: F.create_map(*map(F.lit, kv))
    texts = F.when(F.col("s") == "F", m("en", "text F", "es", "texto F")).when(F.col("s") == "O", m("de", "Text O", "en", "text O")).otherwise(m("fr", "texte P", "de", "Text P"))
    return B.combined_attribution(cited, sources.select("source_id", texts.alias("texts")), "es")


TASKS = "tasks AS (SELECT o_orderkey AS task_id, o_custkey AS plan_id, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' ELSE 'someday' END AS urgency, CASE WHEN o_totalprice > 100000 THEN CAST(o_orderdate AS DATE) END AS due, CAST(floor(o_totalprice) AS BIGINT) AS cost FROM {orders})"


@query(f"""WITH {oracle(TASKS)}, t AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY CASE urgency WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, due ASC NULLS LAST, task_id) AS place FROM tasks)
    SELECT task_id, plan_id, place, CAST(sum(cost) OVER (PARTITION BY plan_id ORDER BY place) AS BIGINT) AS cost_so_far FROM t""")
def urgent_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of a plan by urgency, with running costs."""
    placed = B.by_urgency(rows_of(spark, d, TASKS, "tasks")[0], ["plan_id"])
    return B.cumulative(placed, ["plan_id"], "place", {"cost_so_far": "cost"}).select("task_id", "plan_id", "place", "cost_so_far")


NAMES = "named AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN ' Olea europaea L. ' WHEN 1 THEN 'Vicia sp.' ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Olea europaea' END AS parent, CASE c_custkey % 5 WHEN 0 THEN '  My Tenant@' WHEN 1 THEN '--' ELSE 'T_' END || CAST(c_custkey AS STRING) AS tenant, CASE c_custkey % 4 WHEN 0 THEN ' Winterraps' WHEN 1 THEN 'Wechselweizen' WHEN 2 THEN 'sommergerste' ELSE 'Mais' END AS label, c_acctbal AS x FROM {customer})"


@query(f"""WITH {oracle(NAMES)}, t AS (SELECT *, replace(replace(trim(name), ' ', '_'), '.', '') AS n, trim(regexp_replace(lower(trim(tenant)), '[^a-z0-9]+', '-', 'g'), '-') AS tt FROM named)
    SELECT id, CASE WHEN parent IS NULL THEN concat('urn:ngsi-ld:AgriCrop:', n) ELSE concat('urn:ngsi-ld:AgriCrop:Olea_europaea:', n) END AS uri, CASE WHEN length(tt) BETWEEN 3 AND 63 THEN tt END AS tenant,
        concat('urn:ngsi-ld:AgriCrop:t:p', id, ':2026:', id % 3) AS segment, CASE trim(label) WHEN 'Winterraps' THEN 'winter' WHEN 'Wechselweizen' THEN 'facultative' WHEN 'sommergerste' THEN 'spring' END AS cycle,
        x * 0.0864::DOUBLE AS energy, x * 1.724::DOUBLE AS matter FROM t""")
def names_and_units(spark: SparkSession, d: str) -> DataFrame:
    """Uris, tenant names, cycles from labels, and unit conversions."""
    rows = rows_of(spark, d, NAMES, "named")[0]
    parcel = F.concat(F.lit("urn:ngsi-ld:AgriParcel:t:p"), F.col("id").cast("string"))
    return rows.select(
        "id", B.crop_uri(F.col("name"), F.col("parent")).alias("uri"), B.tenant_id(F.col("tenant")).alias("tenant"),
        B.segment_uri(F.lit("t"), parcel, F.lit("2026"), F.col("id") % 3).alias("segment"), B.crop_cycle(F.col("label")).alias("cycle"),
        B.watts_to_daily_energy(F.col("x")).alias("energy"), B.carbon_to_matter(F.col("x")).alias("matter"),
    )
