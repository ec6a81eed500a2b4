"""Input files: JSON-LD bundles, CSV and JSON reference data, YAML seeds; and keyed sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fields of a bundle's nodes that any of the record types may have.
NODE = (
    "`@type` string, `@id` string, name string, crop_eppo string, crop_scientific string, variety string, year string, trial_location string, "
    "source_id string, mergeKey string, yield_kg_ha string, yield_note_s1 string, irrigation_regime string, production_system string, "
    "quality_params string, agronomic_traits string, disease_scores string, confidence string, ranking_eligible boolean, rootstock string, "
    "planting_year string, skip_ingestion boolean, municipality string, country string, climate_class string, latitude double, longitude double, "
    "elevation_m double, annualRainfallMm double, annualET0Mm double, frostDaysPerYear double, experiment_type string, treatment string, "
    "result_metric string, result_value double, result_unit string, issue_number string, article_title string, article_author string, topic string"
)
RECORD_TYPES = ("VarietyTrial", "TrialSite", "ManagementTrial", "ArticleSource")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of JSON-LD bundles, one row each with the file they came from. A file without ``@graph`` is an error.

    Numbers that sources write as text or objects arrive as text; :func:`trials_of` casts them.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))
    parsed = whole.select("file", F.from_json("value", f"struct<`@graph`:array<struct<{_struct(NODE)}>>>").alias("b"))
    graph = F.when(F.col("b.@graph").isNull(), F.raise_error(F.concat(F.lit("no @graph in "), "file"))).otherwise(F.col("b.@graph"))
    return parsed.select("file", F.explode(graph).alias("node")).select("file", "node.*")


def _struct(ddl: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def by_type(nodes: DataFrame) -> dict[str, DataFrame]:
    """A DataFrame per record type; other types and nodes marked to be skipped are left out."""
    kept = nodes.where(~F.coalesce("skip_ingestion", F.lit(False)))
    return {t: kept.where(F.col("`@type`") == t) for t in RECORD_TYPES}


def trials_of(nodes: DataFrame, mapping: dict[str, str] | None = None, source_id: str | None = None) -> DataFrame:
    """Trials in the library's columns. ``mapping`` renames a source's own fields, so an adapter is a dictionary."""
    for theirs, ours in (mapping or {}).items():
        nodes = nodes.withColumn(ours, F.coalesce(F.col(ours), F.col(theirs))) if ours in nodes.columns else nodes.withColumnRenamed(theirs, ours)
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return nodes.select(
        "crop_eppo", "crop_scientific", "variety", F.col("year").try_cast("int").alias("year"), "trial_location",
        F.coalesce("source_id", F.lit(source_id)).alias("source_id"), number("yield_kg_ha"), number("yield_note_s1"), "irrigation_regime",
        "production_system", F.from_json("disease_scores", "map<string,string>").alias("disease_scores"),
        F.from_json("agronomic_traits", "map<string,string>").alias("agronomic_traits"), "confidence", "ranking_eligible",
        "rootstock", F.col("planting_year").try_cast("int").alias("planting_year"), F.col("mergeKey").alias("merge_key"),
    )


#: Columns of the reference tables that come as CSV with a header, by the name of the table.
REFERENCE_CSV = {
    "growing_cycles": "ScientificName string, CycleLow int, CycleHigh int, LifeForm string, Family string",
    "feeds": "eppo_code string, crude_protein_pct double, organic_matter_digestibility_pct double",
    "permitted_inputs": "product_name string, active_substance string, category string, target_pests string",
}
#: The library's names of their columns.
REFERENCE_NAMES = {
    "growing_cycles": {"ScientificName": "scientific_name", "CycleLow": "cycle_min", "CycleHigh": "cycle_max"}, "feeds": {}, "permitted_inputs": {"product_name": "product"},
}


def read_reference(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of the tables of :data:`REFERENCE_CSV` under the library's names."""
    return read_reference_csv(spark, path, REFERENCE_CSV[kind]).withColumnsRenamed(REFERENCE_NAMES[kind])


def capabilities(manifests: DataFrame) -> DataFrame:
    """A row per attribute that a module publishes: module_id, version, entity_type, attribute, unit, sources.

    ``manifests``: moduleId, version, publishes (array of entityType and attributes). Modules that publish nothing have none.
    """
    published = manifests.select(F.col("moduleId").alias("module_id"), "version", F.explode("publishes").alias("p"))
    attributes = published.select("module_id", "version", F.col("p.entityType").alias("entity_type"), F.explode("p.attributes").alias("a"))
    return attributes.select("module_id", "version", "entity_type", F.col("a.name").alias("attribute"), F.col("a.unitCode").alias("unit"), F.col("a.sources").alias("sources"))


def read_reference_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV reference table with a header; what doesn't parse is null."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", enforceSchema=False)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Scraped observations as a JSON array or lines."""
    ddl = "species_eppo string, variety string, location string, climate_class string, management string, yield_kg_ha double, notes string, source_pdf string, campaign string"
    return spark.read.json(path, schema=ddl, multiLine=True)


def read_yaml_seed(spark: SparkSession, path: str, key: str, schema: str, max_bytes: int = 16 << 20) -> DataFrame:
    """One list of a YAML seed file. Seeds are files of constants, parsed on the driver: more than ``max_bytes`` are an error.

    Needs a YAML parser installed.
    """
    import yaml

    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"{path} has {size} bytes; a seed has {max_bytes} at most")
    text = "\n".join(bytes(r["content"]).decode("utf-8") for r in files.select("content").collect())
    fields = StructType.fromDDL(schema).names
    return spark.createDataFrame([tuple(row.get(f) for f in fields) for row in yaml.safe_load(text)[key]], schema)


def overwrite_by_partition(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions that ``df`` has rows for; running it twice leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` unless a key repeats or is null: then the job that reads the result fails."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    bad = (F.col("__n") > 1) | F.concat_ws("|", *(F.when(F.col(k).isNull(), "x") for k in keys)).contains("x")
    checked = counted.withColumn("__ok", F.when(bad, F.raise_error(F.lit(f"keys {keys} are not unique"))).otherwise(F.lit(True)))
    return df.join(checked.select(*keys, "__ok"), keys, "left").where(F.coalesce("__ok", F.lit(True))).select(*df.columns)
