"""Action rules: condition trees as expressions, and advisories."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Kinds of values that can be compared with each other, by the type of a column.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def condition(tree: dict | str | None, columns: dict[str, str]) -> Column:
    """A condition tree ``{"all": [{field, op, value}]}`` as a boolean column, never null.

    ``columns``: name -> type of the context. An empty tree is true. A clause is false, whatever its operator, if its field
    is not named, not in the context or null (a null is a missing observation, also for ``nin``), if the operator is not
    known, or if the value can't be compared with the field: a list with ``eq`` or an order, no list or text with ``in``.
    Values of another kind (text, number, boolean) are equal to nothing, so they are in no list and ``nin`` passes them by.
    A text with ``in`` is searched for the field's text.
    """
    parsed = json.loads(tree) if isinstance(tree, str) else tree or {}
    return reduce(lambda a, b: a & b, (_clause(c, columns) for c in parsed.get("all") or []), F.lit(True))


def _kind(value: object) -> str | None:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string" if isinstance(value, str) else None


def _clause(clause: dict, columns: dict[str, str]) -> Column:
    name, op, value = clause.get("field"), clause.get("op"), clause.get("value")
    if name not in columns:
        return F.lit(False)
    field, kind = F.col(f"`{name}`"), columns[name].split("(")[0]
    kind = "number" if kind in NUMBERS else kind
    test: Column | None = None
    if op in ("in", "nin"):
        if isinstance(value, list):
            test = field.isin([v for v in value if _kind(v) == kind])
        elif isinstance(value, str) and kind == "string":
            test = F.lit(value).contains(field)
        if test is not None and op == "nin":
            test = ~test
    elif _kind(value) == kind:
        compare = {"eq": field.__eq__, "lte": field.__le__, "gte": field.__ge__, "gt": field.__gt__, "lt": field.__lt__}.get(op)
        test = compare(F.lit(value)) if compare else None
    return F.lit(False) if test is None else field.isNotNull() & F.coalesce(test, F.lit(False))


RULE_DDL = "struct<rule_id:string,priority:int,urgency:string,template:string>"


def match_rules(contexts: DataFrame, rules: list[dict], species_column: str = "species") -> DataFrame:
    """contexts x rules that hold: an active rule without species links is generic, else it holds for its species only.

    The rules are few and compiled; each context row is read once and exploded to the rules that match. No rules, or none
    that is active, give no rows.
    """
    columns = dict(contexts.dtypes)
    found = []
    for rule in rules:
        if not rule.get("active", True):
            continue
        fits = condition(rule.get("conditions"), columns)
        if links := rule.get("species_links"):
            fits = fits & (F.coalesce(F.col(species_column).isin(links), F.lit(False)) if species_column in columns else F.lit(False))
        action = rule.get("action") or {}
        found.append(F.when(fits, F.struct(
            F.lit(rule["id"]).alias("rule_id"), F.lit(rule.get("priority", 0)).cast("int").alias("priority"),
            F.lit(action.get("urgency")).cast("string").alias("urgency"), F.lit(action.get("description_template", "")).alias("template"),
        )))
    held = F.array(*found).cast(f"array<{RULE_DDL}>")
    return contexts.withColumn("rule", F.explode(F.array_compact(held))).select(*contexts.columns, "rule.*")


def render(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by its value, in the given order; a null value leaves the mark as it is."""
    return reduce(lambda t, kv: F.when(kv[1].isNull(), t).otherwise(F.replace(t, F.lit("{" + kv[0] + "}"), kv[1].cast("string"))), values.items(), template)


def advisories(matched: DataFrame, tenant: str, values: list[str]) -> DataFrame:
    """One advisory per tenant, parcel, rule and stage, with its text; the id makes a replay overwrite, not repeat."""
    key = F.concat_ws(":", F.lit("advisory"), F.lit(tenant), F.col("parcel_id").cast("string"), "rule_id", "stage")
    return matched.select(
        key.alias("advisory_id"), "parcel_id", "rule_id", "stage", "urgency", "priority", render(F.col("template"), {v: F.col(v) for v in values}).alias("description")
    )
