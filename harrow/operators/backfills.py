"""Back-fills, identities and checks of stored trial data: each a join or an expression that can be applied again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import agronomy as A
from harrow.operators.parts import holding

#: Yield response factor by growth stage (fixed values); any other stage has the last one.
KY_BY_STAGE = {
    "vegetative": 0.45, "germination": 0.40, "emergence": 0.40, "stem_elongation": 0.60, "booting": 0.80, "heading": 0.95, "flowering": 1.15, "anthesis": 1.15,
    "grain_filling": 0.85, "fruit_set": 1.00, "pit_hardening": 0.85, "kernel_fill": 0.85, "fruit_growth": 0.70, "veraison": 0.85, "ripening": 0.50,
    "maturity": 0.35, "senescence": 0.30, "dormancy": 0.10,
}
KY_OTHER = 0.45
#: Words of a source's title that tell its species, in order of precedence (fixed values).
SPECIES_WORDS = [
    ("olive", "olive"), ("almond", "almond"), ("wheat", "wheat"), ("grape", "wine grapes"), ("wine", "wine grapes"), ("maize", "maize"), ("corn", "maize"), ("rice", "rice"),
    ("soybean", "soybean"), ("sunflower", "sunflower"), ("cotton", "cotton"), ("alfalfa", "alfalfa"), ("tomato", "tomato"), ("potato", "potato"), ("onion", "onion"),
    ("barley", "barley"), ("oat", "oat"), ("rye", "rye"), ("sorghum", "sorghum"), ("millet", "millet"), ("chickpea", "chickpea"), ("lentil", "lentil"), ("pea", "peas"),
    ("pisum", "peas"), ("faba", "beans"), ("vicia", "beans"), ("rapeseed", "rapeseed"), ("canola", "rapeseed"), ("sugarcane", "sugarcane"),
]
#: Endings of a source's trait keys that don't change their meaning, in order of precedence, and other variants (fixed values).
KEY_ENDINGS = ["_pct", "_scale", "_escala", "_escala_0_9", "_0_9", "_0-9", "_score", "_percent", "_percentage"]
KEY_PLURALS = {"podredumbres": "podredumbre", "plantas": "planta"}
KEY_PREFIXES = ["anfaelligkeit_fuer_", "anfaelligkeit_"]
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
SOURCE_TYPES = ("global_standard", "peer_reviewed_study", "extension_advisory")
URGENCY = {"high": 0, "medium": 1, "low": 2}


def reconcile_effects(constraints: DataFrame, truth: DataFrame) -> DataFrame:
    """``constraints`` (crop_a, crop_b, effect) with the effect that ``truth`` wants and what is done: ``already`` right,
    ``written``, or ``unknown`` to the truth and left as it is. A second pass writes nothing."""
    wanted = truth.select("crop_a", "crop_b", F.col("effect").alias("wanted"))
    joined = constraints.join(wanted, ["crop_a", "crop_b"], "left")
    status = F.when(F.col("wanted").isNull(), "unknown").when(F.col("effect").eqNullSafe(F.col("wanted")), "already").otherwise("written")
    return joined.select("crop_a", "crop_b", F.coalesce("wanted", "effect").alias("effect"), status.alias("status"))


def tag_management(trials: DataFrame, rules: list[tuple[str, str | None, str]], default: str = "conventional") -> DataFrame:
    """``trials`` (source_name, crop_group, management) with the management filled where it is null: by the first rule
    (part of the source's name, part of the crop group or none, tag) that fits, else the default."""
    fits = lambda s, g: F.col("source_name").contains(s) & (F.coalesce(F.col("crop_group").contains(g), F.lit(False)) if g else F.lit(True))
    tag = F.coalesce(*(F.when(F.coalesce(fits(s, g), F.lit(False)), t) for s, g, t in rules), F.lit(default))
    return trials.withColumn("management", F.coalesce("management", tag))


def link_orphan_params(params: DataFrame, linked: DataFrame) -> DataFrame:
    """param_id, species, stage: parameter sets that no species or crop holds, placed by the first known word in their
    source's title; the stage is the cultivar or ``generic``. Sets without such a word stay orphans and are left out."""
    title = F.lower("source_short")
    species = F.coalesce(*(F.when(title.contains(word), name) for word, name in SPECIES_WORDS))
    orphans = params.where("source_short IS NOT NULL").join(linked.select("param_id").distinct(), "param_id", "left_anti")
    return orphans.select("param_id", species.alias("species"), F.coalesce("cultivar", F.lit("generic")).alias("stage")).where("species IS NOT NULL")


def fill_ky(params: DataFrame) -> DataFrame:
    return params.withColumn("ky", F.coalesce("ky", F.element_at(A.lit_map(KY_BY_STAGE), F.col("stage")), F.lit(KY_OTHER)))


def thermal_limits(crops: DataFrame, margin: float = 2.0) -> DataFrame:
    """crop_id, heat_damage_c (absolute maximum less a margin), frost_damage_c (absolute minimum if below zero); crops with neither are left out."""
    heat, frost = F.col("temp_max_abs") - margin, F.when(F.col("temp_min_abs") < 0, F.col("temp_min_abs"))
    return crops.select("crop_id", heat.alias("heat_damage_c"), frost.alias("frost_damage_c")).where("heat_damage_c IS NOT NULL OR frost_damage_c IS NOT NULL")


def source_type(explicit: Column, short: Column, doi: Column) -> Column:
    """Kind of a source: as stated, else a standard by its short name, else a study if it has a DOI, else an advisory."""
    name = F.trim(F.coalesce(short, F.lit("")))
    return (
        F.when(explicit.isin(*SOURCE_TYPES), explicit).when(F.upper(name).startswith("FAO") | name.contains("Steduto"), "global_standard")
        .when(F.coalesce(doi, F.lit("")) != "", "peer_reviewed_study").otherwise("extension_advisory")
    )


def fill_places(sites: DataFrame, registry: DataFrame, aggregates: list[str], columns: list[str]) -> DataFrame:
    """``sites`` with ``columns`` from the registry, by name, where the latitude is unknown; ``status`` says what was done.

    Names of aggregates (those that hold one of the given parts) are skipped; a registry's nulls change nothing.
    """
    name = F.lower(F.trim("name"))
    entry = registry.select(F.lower(F.trim("name")).alias("__key"), F.struct(*columns).alias("__entry"))
    joined = sites.join(entry, name == F.col("__key"), "left")
    open_ = F.col("latitude").isNull() & F.col("name").isNotNull()
    aggregate = reduce(lambda a, b: a | b, (name.contains(p) for p in aggregates))
    status = F.when(~open_, "known").when(aggregate, "aggregate").when(F.col("__entry").isNull(), "not in registry").otherwise("filled")
    marked = joined.withColumn("status", status)
    value = lambda c: F.when(F.col("status") == "filled", F.coalesce(F.col(f"__entry.{c}"), F.col(c))).otherwise(F.col(c))
    return marked.select(*((value(c).alias(c) if c in columns else F.col(c)) for c in sites.columns), "status")


def lookup_by_part(asked: DataFrame, registry: DataFrame, text: str, into: list[str]) -> DataFrame:
    """``asked`` with the columns ``into`` of the entry whose key equals the text (trimmed, lower-case), else of the first entry
    in the registry's ``place`` whose key holds the text or is held by it; null if there is none.

    Equal keys are found by an equi-join; only distinct texts without one are looked up by their parts.
    """
    key = F.lower(F.trim(F.col(text)))
    named = asked.withColumn("__key", F.when(key != "", key))
    exact = registry.groupBy(F.col("key").alias("__key")).agg(F.min_by(F.struct(*into), "place").alias("__exact"))
    missing = named.select("__key").where("__key IS NOT NULL").distinct().join(exact, "__key", "left_anti")
    pairs = holding(missing, "__key", registry, "key").unionByName(holding(registry, "key", missing, "__key"))
    part = pairs.join(registry, "key").groupBy("__key").agg(F.min_by(F.struct(*into), "place").alias("__part"))
    found = named.join(exact, "__key", "left").join(part, "__key", "left").withColumn("__found", F.coalesce("__exact", "__part"))
    return found.select(*asked.columns, *(F.col(f"__found.{c}").alias(c) for c in into))


def update_by_natural_key(rows: DataFrame, updates: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``rows`` with ``column`` taken from ``updates`` where all ``keys`` agree but for case and outer blanks; nulls match nothing."""
    folded = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    new = updates.select(*(folded(k).alias(f"__{k}") for k in keys), F.col(column).alias("__new"))
    new = new.groupBy(*(f"__{k}" for k in keys)).agg(F.max("__new").alias("__new"))
    joined = rows.join(new, [folded(k) == F.col(f"__{k}") for k in keys], "left")
    return joined.select(*(F.coalesce("__new", column).alias(column) if c == column else F.col(c) for c in rows.columns))


def rootstock_links(trials: DataFrame, rootstocks: DataFrame) -> DataFrame:
    """trial_id, rootstock_id by a key composed of the rootstock's name and the crop, code before scientific name."""
    crop = F.lower(F.coalesce("crop_eppo", "crop_scientific", F.lit("")))
    key = F.concat(F.lit("rootstock|"), F.lower(F.trim("rootstock")), F.lit("|"), crop)
    return trials.where("rootstock IS NOT NULL").select("trial_id", key.alias("merge_key")).join(rootstocks, "merge_key").select("trial_id", "rootstock_id").distinct()


def absorb_sites(links: DataFrame, sites: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and sites after the sites in ``merged`` (site_id, survivor_id) have gone into their survivors; no trial is lost."""
    gone = merged.where("site_id <> survivor_id").select("site_id", "survivor_id")
    moved = links.join(gone, "site_id", "left").select("trial_id", F.coalesce("survivor_id", "site_id").alias("site_id")).distinct()
    return moved, sites.join(gone, "site_id", "left_anti")


def migration_report(before: DataFrame, after: DataFrame, sites_before: DataFrame, sites_after: DataFrame, trials: DataFrame) -> DataFrame:
    """One row of counts before and after sites were merged; a lost link of a trial is an error when the row is read."""
    linked = lambda df, n: df.agg(F.count_distinct("trial_id").alias(n))
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    parts = (count(trials, "trials"), count(sites_before, "sites_before"), count(sites_after, "sites_after"), linked(before, "linked_before"), linked(after, "linked_after"))
    row = reduce(DataFrame.crossJoin, parts)  # each has one row
    fine = F.assert_true(F.col("linked_after") == F.col("linked_before"), "trials lost their sites").isNull()
    return row.where(fine).select("trials", "sites_before", "sites_after", (F.col("trials") - F.col("linked_before")).alias("orphans_before"), (F.col("trials") - F.col("linked_after")).alias("orphans_after"))


def key_forms(key: Column) -> Column:
    """Forms under which a raw trait key may be known, with their precedence: itself, without an ending, singular, without a
    prefix, and with umlauts spelt out."""
    form = lambda n, c: F.struct(F.lit(n).alias("rank"), c.alias("form"))
    forms = [form(0, key)]
    forms += [F.when(key.endswith(e), form(1 + i, F.substring(key, F.lit(1), F.length(key) - len(e)))) for i, e in enumerate(KEY_ENDINGS)]
    forms += [F.when(key.contains(p), form(20 + i, F.replace(key, F.lit(p), F.lit(s)))) for i, (p, s) in enumerate(KEY_PLURALS.items())]
    forms += [F.when(key.startswith(p), form(30 + i, F.substring(key, F.lit(len(p) + 1), F.length(key)))) for i, p in enumerate(KEY_PREFIXES)]
    return F.array_compact(F.array(*forms, form(40, spelt(key))))


def spelt(text: Column) -> Column:
    return reduce(lambda c, u: F.replace(c, F.lit(u[0]), F.lit(u[1])), UMLAUTS.items(), text)


def match_trait_keys(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """id, trait, raw_key: for each record and registered trait the raw key that names it, by precedence of its form, then by name.

    ``raw``: id, source_id, raw_key. ``registry``: source_id, key, trait; a key with a prefix may also be met without it.
    """
    known = registry.select("source_id", "trait", F.explode(F.array_compact(F.array(
        F.col("key"), F.when(spelt(F.col("key")) != F.col("key"), spelt(F.col("key"))),
        *(F.when(F.col("key").startswith(p), F.substring("key", F.lit(len(p) + 1), F.length("key"))) for p in KEY_PREFIXES),
    ))).alias("form")).distinct()
    forms = raw.select("id", "source_id", "raw_key", F.explode(key_forms(F.col("raw_key"))).alias("f")).select("id", "source_id", "raw_key", "f.*")
    hits = forms.join(known, ["source_id", "form"])
    return hits.groupBy("id", "trait").agg(F.min(F.struct("rank", "raw_key")).alias("best")).select("id", "trait", F.col("best.raw_key").alias("raw_key"))


def first_per_key(rows: DataFrame, keys: list[str], maps: str, order: list[Column]) -> DataFrame:
    """keys, name, value: of all maps of a group the first value of each name in the given order."""
    each = rows.select(*keys, F.struct(*order).alias("__order"), F.explode(maps).alias("name", "value"))
    return each.groupBy(*keys, "name").agg(F.min_by("value", "__order").alias("value"))


def unmapped(trials: DataFrame, codes: DataFrame, locations: DataFrame, traits: DataFrame) -> DataFrame:
    """kind, value, records: what a source's records use that no registry knows, and records without a required field."""
    code = F.upper(F.trim(F.regexp_replace("crop_eppo", "(?i)eppo:", "")))
    crop = trials.where(F.coalesce(code, F.lit("")) != "").select(code.alias("value")).join(codes.select(F.col("eppo").alias("value")), "value", "left_anti").select(F.lit("crop").alias("kind"), "value")
    place = F.lower(F.trim("location"))
    located = trials.where(F.coalesce(place, F.lit("")) != "").select(place.alias("value")).join(locations.select(F.lower("name").alias("value")), "value", "left_anti").select(F.lit("location").alias("kind"), "value")
    key = trials.select(F.explode(F.map_keys("traits")).alias("value")).join(traits.select(F.col("key").alias("value")), "value", "left_anti").select(F.lit("trait").alias("kind"), "value")
    gaps = F.array_compact(F.array(*(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), c) for c in ("crop_eppo", "variety", "year"))))
    missing = trials.select(F.lit("required").alias("kind"), F.explode(gaps).alias("value"))
    return reduce(DataFrame.unionAll, (crop, located, key, missing)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("records"))


def contributions(offered: DataFrame) -> DataFrame:
    """Offered parameters as rows to append: open for review, never a default, named after their author."""
    marked = F.lit("__contributed__")
    return offered.withColumns({
        "cultivar": F.coalesce("cultivar", marked), "management": F.coalesce("management", marked), "climate_zone": marked, "is_default": F.lit(False),
        "source_short": F.concat(F.lit("Contributed: "), F.coalesce("author", F.lit("anonymous"))), "status": F.lit("pending_review"),
    })


def combined_attribution(cited: DataFrame, sources: DataFrame, locale: str) -> DataFrame:
    """page, text: the attributions of a page's sources in order, each once. Texts are in the locale, else English, else any
    (the first by language); unknown sources are passed over."""
    text = F.coalesce(F.get(F.map_values(F.map_filter("texts", lambda k, _: k == locale)), 0), F.get(F.map_values(F.map_filter("texts", lambda k, _: k == "en")), 0),
                      F.get(F.array_sort(F.map_entries("texts")), 0)["value"])
    named = cited.join(sources.select("source_id", text.alias("text")), "source_id").where("text IS NOT NULL")
    lists = named.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("found"))
    return lists.select("page", F.array_join(F.array_distinct(F.transform("found", lambda x: x["text"])), " ").alias("text"))


def by_urgency(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """``tasks`` with their ``place`` by urgency (unknown ones last), then the due date (none last), then id."""
    rank = F.coalesce(F.element_at(A.lit_map(URGENCY), F.col("urgency")), F.lit(len(URGENCY)))
    return tasks.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, F.col("due").asc_nulls_last(), "task_id")))


def cumulative(rows: DataFrame, keys: list[str], order: str, totals: dict[str, str]) -> DataFrame:
    """``rows`` with running totals (name -> column) of each group in order."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({n: F.sum(c).over(so_far) for n, c in totals.items()})


def crop_uri(name: Column, parent: Column | None = None) -> Column:
    """``urn:ngsi-ld:AgriCrop:`` and the name with blanks as underscores and no dots; a variety follows its species."""
    tidy = lambda c: F.replace(F.replace(F.trim(c), F.lit(" "), F.lit("_")), F.lit("."), F.lit(""))
    plain = F.concat(F.lit("urn:ngsi-ld:AgriCrop:"), tidy(name))
    return plain if parent is None else F.when(parent.isNull(), plain).otherwise(F.concat(F.lit("urn:ngsi-ld:AgriCrop:"), tidy(parent), F.lit(":"), tidy(name)))


def segment_uri(tenant: Column, parcel: Column, season: Column, number: Column) -> Column:
    return F.concat_ws(":", F.lit("urn:ngsi-ld:AgriCrop"), tenant, F.element_at(F.split(parcel, ":"), -1), season, number.cast("string"))


def tenant_id(text: Column, shortest: int = 3, longest: int = 63) -> Column:
    """Lower-case letters, digits and single hyphens; null where nothing valid of that length is left."""
    tidy = F.trim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(F.length(tidy).between(shortest, longest), tidy)


def crop_cycle(label: Column) -> Column:
    """Growing cycle from the start of a German crop label; null where it tells none."""
    low = F.lower(F.trim(label))
    return F.when(low.startswith("wechsel"), "facultative").when(low.startswith("winter"), "winter").when(low.startswith("sommer"), "spring")


def watts_to_daily_energy(watts: Column) -> Column:
    """A day's energy of a mean W/m2 (86,400 seconds, in millions)."""
    return watts * 0.0864


def carbon_to_matter(organic_carbon: Column) -> Column:
    """Soil organic matter from organic carbon."""
    return organic_carbon * 1.724
