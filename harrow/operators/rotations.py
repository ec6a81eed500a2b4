"""Rotations by a bounded search over states: the last crops and the nitrogen of the soil, year by year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.sources.scratch import written

#: Figures that a year's priorities weigh.
DIMENSIONS = ("protein", "carbon", "n_fixation", "margin", "yield")


def yearly_weights(weights: DataFrame, years: int) -> DataFrame:
    """year_no and a weight for each dimension, in percent of the year's sum; years that aren't given have those of year 1, else all alike.

    ``weights``: year_no and the dimensions. A year whose weights are all zero is an error.
    """
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(d), F.lit(0.0)) for d in DIMENSIONS))
    share = F.when(total > 0, total).otherwise(F.raise_error(F.lit("all of a year's weights are zero")).cast("double"))
    given = weights.select("year_no", *((F.coalesce(F.col(d), F.lit(0.0)) / share * 100).alias(d) for d in DIMENSIONS))
    first = given.where("year_no = 1").select(*(F.col(d).alias(f"first_{d}") for d in DIMENSIONS))
    all_years = weights.sparkSession.range(1, years + 1).select(F.col("id").cast("int").alias("year_no"))
    rows = all_years.join(given, "year_no", "left").join(first, F.lit(True), "left")
    return rows.select("year_no", *(F.coalesce(d, f"first_{d}", F.lit(100.0 / len(DIMENSIONS))).alias(d) for d in DIMENSIONS))


def arcs(figures: DataFrame, successors: DataFrame, before: DataFrame, weights: DataFrame) -> DataFrame:
    """zone, previous, year_no, crop, score, n_fixation, n_requirement: what may follow a crop in a zone, with its score by the year's weights.

    ``figures``: zone, crop, the dimensions and n_requirement; ``successors``: previous, crop; ``before``: zone, previous, other than the zone's own crops.
    Successors that the zone has follow a crop; where it has none, all its crops do. A crop never follows itself. A figure counts as its
    share of the largest among the candidates, zero if it is not above zero.
    """
    crops = figures.select("zone", F.col("crop").alias("previous"))
    pairs = before.select("zone", "previous").unionByName(crops).distinct().join(figures, "zone").where("NOT previous <=> crop")
    named = pairs.join(successors.select("previous", "crop", F.lit(True).alias("named")).distinct(), ["previous", "crop"], "left")
    whole = Window.partitionBy("zone", "previous")
    candidates = named.withColumn("any_named", F.count("named").over(whole) > 0).where("named OR NOT any_named")
    shares = {d: F.when(F.col(d) > 0, F.col(d) / F.max(d).over(whole)).otherwise(0.0).alias(f"share_{d}") for d in DIMENSIONS}
    rated = candidates.select("zone", "previous", "crop", "n_fixation", "n_requirement", *shares.values())
    years = weights.select("year_no", *(F.col(d).alias(f"weight_{d}") for d in DIMENSIONS))
    score = F.round(reduce(lambda a, b: a + b, (F.col(f"weight_{d}") * F.col(f"share_{d}") for d in DIMENSIONS)), 1)
    return rated.crossJoin(F.broadcast(years)).select("zone", "previous", "year_no", "crop", score.alias("score"), "n_fixation", "n_requirement")


def best_rotations(parcels: DataFrame, figures: DataFrame, successors: DataFrame, weights: DataFrame, locked: DataFrame, years: int = 4,
                   beam: int = 1, gap: int = 1, shortage_cost: float = 0.0, start_n: float = 50.0) -> DataFrame:
    """parcel_id, crops, scores, score, soil_n: a rotation of each parcel with the highest sum of scores that the search finds.

    ``parcels``: parcel_id, zone, previous, cover_n (nitrogen that a cover crop adds each year); ``locked``: parcel_id, year_no, crop. A
    locked year has its crop whatever came before, with a score of zero. A crop may not return within ``gap`` years. The soil's
    nitrogen is never below zero: what a year needs beyond it costs ``shortage_cost`` a kilogram. A parcel for which a year has no
    candidate has no plan, nor has one of a zone without figures.

    Of partial plans that are in the same state (the last ``gap`` crops and the nitrogen) only the best goes on, and of a question's
    states the ``beam`` best by score, ties by their crops. One is the greedy plan; a beam as wide as there are states
    is exact. So a question has at most ``beam`` rows a year, and each year is one join with the arcs, which grow with the zones alone.

    A question is all that counts for a parcel: zone, previous crop, cover_n and locks. Parcels with the same one have it searched once;
    where all differ, there are as many searches as parcels.
    """
    if not 2 <= years <= 6:
        raise ValueError("a rotation has two to six years")
    locks = locked.where(F.col("year_no").between(1, years)).groupBy("parcel_id").agg(F.sort_array(F.collect_set(F.struct("year_no", "crop"))).alias("locks"))
    asked = parcels.join(locks, "parcel_id", "left").select("parcel_id", "zone", "previous", F.coalesce("cover_n", F.lit(0.0)).alias("cover_n"), F.coalesce("locks", F.array().cast(locks.schema["locks"].dataType)).alias("locks"))
    question = ["zone", "previous", "cover_n", "locks"]
    questions = written(asked.select(*question).distinct().withColumn("question_id", F.monotonically_increasing_id()), "questions")
    steps = written(arcs(figures, successors, questions.select("zone", "previous"), yearly_weights(weights, years)), "arcs")
    fixed = questions.select("question_id", "zone", F.inline("locks")).join(figures.select("zone", "crop", "n_fixation", "n_requirement"), ["zone", "crop"])
    fixed = written(fixed.select("question_id", "year_no", F.col("crop").alias("l_crop"), F.lit(0.0).alias("l_score"), F.col("n_fixation").alias("l_fix"), F.col("n_requirement").alias("l_need")), "locks")
    none = F.array().cast("array<string>")
    plans = questions.select(
        "question_id", "zone", "cover_n", "previous", none.alias("crops"), F.array().cast("array<double>").alias("scores"),
        F.lit(0.0).alias("score"), F.lit(start_n).alias("soil_n"),
    )
    for year in range(1, years + 1):
        lock = fixed.where(F.col("year_no") == year).drop("year_no")
        free = plans.join(lock.select("question_id"), "question_id", "left_anti").alias("p").join(
            steps.where(F.col("year_no") == year).alias("a"), (F.col("p.zone") == F.col("a.zone")) & F.col("p.previous").eqNullSafe(F.col("a.previous"))
        ).where(~F.array_contains(F.slice(F.reverse("crops"), 1, gap), F.col("a.crop"))).select("p.*", "a.crop", F.col("a.score").alias("gain"), "a.n_fixation", "a.n_requirement")
        held = plans.join(lock, "question_id").select(*plans.columns, F.col("l_crop").alias("crop"), F.col("l_score").alias("gain"), F.col("l_fix").alias("n_fixation"), F.col("l_need").alias("n_requirement"))
        left = F.col("soil_n") + F.col("n_fixation") - F.col("n_requirement")
        moved = free.unionByName(held).repartition("question_id").select(  # lies by question for both windows
            "question_id", "zone", "cover_n", F.col("crop").alias("previous"), F.array_append("crops", F.col("crop")).alias("crops"), F.array_append("scores", F.col("gain")).alias("scores"),
            F.round(F.col("score") + F.col("gain") - F.lit(shortage_cost) * F.greatest(F.lit(0.0), -left), 6).alias("score"),
            F.round(F.greatest(F.lit(0.0), left) + F.col("cover_n"), 3).alias("soil_n"),
        )
        state = Window.partitionBy("question_id", F.slice(F.reverse("crops"), 1, max(gap, 1)), "soil_n").orderBy(F.desc("score"), "crops")
        best = Window.partitionBy("question_id").orderBy(F.desc("score"), "crops")
        moved = moved.withColumn("r", F.row_number().over(state)).where("r = 1") if beam > 1 else moved
        plans = moved.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r")
        plans = written(plans, "plans") if beam > 1 and year < years else plans
    found = written(plans.select("question_id", "crops", "scores", "score", "soil_n").join(questions, "question_id").drop("question_id"), "rotations")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in question]
    final = Window.partitionBy("parcel_id").orderBy(F.desc("score"), "crops")
    rows = asked.alias("p").join(found.alias("f"), same).select("parcel_id", "crops", "scores", "score", "soil_n")
    return rows.withColumn("r", F.row_number().over(final)).where("r = 1").drop("r")
