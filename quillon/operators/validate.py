"""Validation of form fields: rows (form, pos, name, type, value, checked) against rules, and reports of errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.predicates import BUILT_IN, Rule, in_error, looked_at
from quillon.sources.places import stored

#: Attributes of a field that ask for a rule, and the attributes that stand in for them.
ATTRIBUTES = {"pattern": (), "max": ("aria_valuemax",), "min": ("aria_valuemin",), "maxlength": (), "minlength": (), "maxchecked": (), "minchecked": ()}
#: Names that a list of a start's names is bound to, about.
BLOCK = 1 << 20


def field_values(fields: DataFrame) -> DataFrame:
    """fields with value as it counts: '' for a box that is not checked, and for radios of a group with none checked."""
    group = Window.partitionBy("form", "name")
    any_checked = F.max(F.when(F.col("type") == "radio", F.col("checked")).otherwise(F.lit(False))).over(group)
    value = F.when((F.col("type") == "checkbox") & ~F.col("checked"), F.lit("")).when((F.col("type") == "radio") & ~any_checked, F.lit("")).otherwise(F.col("value"))
    return fields.withColumn("value", value)


def attribute_rules(fields: DataFrame) -> DataFrame:
    """form, name, rule and param, one row for each attribute that asks for a rule."""
    have = set(fields.columns)
    pairs = []
    for rule, others in ATTRIBUTES.items():
        given = [F.col(c).cast("string") for c in (rule, *others) if c in have]
        if given:
            pairs.append(F.struct(F.lit(rule).alias("rule"), F.coalesce(*given).alias("param")))
    if "required" in have:
        required = F.coalesce(F.col("required"), F.lit(False))
        if "aria_required" in have:
            required = required | F.coalesce(F.col("aria_required"), F.lit(False))
        pairs.append(F.struct(F.lit("required").alias("rule"), F.when(required, F.lit("true")).alias("param")))
    if "type" in have:
        pairs += [F.struct(F.lit(t).alias("rule"), F.when(F.col("type") == t, F.lit("true")).alias("param")) for t in ("number", "email")]
    return fields.select("form", "name", F.explode(F.array(*pairs)).alias("r")).where("r.param is not null").select("form", "name", "r.rule", "r.param")


def reached(name: str, registry: dict[str, Rule]) -> list[str]:
    """The rules that a name leads to through shortcuts, itself included; a cycle ends where it comes back."""
    found, todo = [], [name]
    while todo:
        name = todo.pop().lower()
        if name not in found:
            found.append(name)
            rule = registry.get(name)
            todo += [x.strip() for x in str(rule.value).split(",")] if rule is not None and rule.type == "shortcut" else []
    return found


def revalidated(changed: DataFrame, fields: DataFrame, rules: dict[str, list[Rule]], group: str) -> DataFrame:
    """group, messages and n_fields of the groups of fields that one changed: all fields of such a group are looked at again.

    changed (form, name, pos, and the group's column) are the fields that had an event; several events of a group are one.
    messages are the different errors of the group's fields in order, or null without errors.
    """
    touched = changed.select("form", group).distinct()
    again = check_fields(fields.join(touched, ["form", group], "left_semi"), rules)
    found = again.groupBy("form", group).agg(F.flatten(F.collect_list("errors")).alias("all"), F.count("*").alias("n_fields"))
    messages = F.when(F.size("all") > 0, error_text(F.col("all")))
    return found.select("form", group, messages.alias("messages"), "n_fields")


def closure(start: DataFrame, rules: DataFrame) -> DataFrame:
    """start and name of all rules that the names in start (column name) lead to through shortcuts, themselves included.

    rules (name, type, value): a shortcut's value lists the names it stands for, parted by commas; names are compared in lower case,
    a name that rules does not have leads to itself only. Each round follows the shortcuts of the pairs that the last one
    found, drops pairs that are known and ends where none is new, so cycles end; rounds are as many as the longest chain of
    shortcuts. Names are numbers meanwhile, and what a start has reached are lists of them, parted into blocks of about BLOCK names, so
    a list is bounded and what travels again in each round are lists. Each round is a table in the shared folder.
    """
    targets = F.transform(F.split("value", ","), lambda x: F.lower(F.trim(x)))
    named = rules.where("type = 'shortcut' AND value IS NOT NULL").select(F.lower("name").alias("of"), F.explode(targets).alias("to"))
    named = stored(named.where("of IS NOT NULL").distinct())
    starts = stored(start.where("name IS NOT NULL").select(F.col("name").alias("text")).distinct().select("text", F.monotonically_increasing_id().alias("start")))
    names = named.select(F.explode(F.array("of", "to")).alias("name")).unionByName(starts.select(F.lower("text").alias("name"))).distinct()
    names = stored(names.select("name", F.monotonically_increasing_id().alias("id")))
    block = F.col("to") % (names.count() // BLOCK + 1)
    links = named.join(names.select(F.col("name").alias("of"), F.col("id").alias("k")), "of").join(names.select(F.col("name").alias("to"), "id"), "to")
    links = stored(links.select(F.col("k").alias("of"), F.col("id").alias("to")))
    fresh = starts.join(names, F.lower("text") == F.col("name")).select("start", F.col("id").alias("to"))
    fresh = stored(fresh.select("start", block.alias("block"), F.array("to").alias("names")))
    known = fresh
    while not fresh.isEmpty():
        found = fresh.select("start", F.explode("names").alias("of")).join(links, "of").select("start", block.alias("block"), "to")
        both = found.unionByName(known, allowMissingColumns=True).groupBy("start", "block")
        new = both.agg(F.array_except(F.collect_set("to"), F.flatten(F.collect_list("names"))).alias("names"))
        fresh = stored(new.where(F.size("names") > 0))
        known = known.unionByName(fresh)
    pairs = known.select("start", F.explode("names").alias("id")).join(names, "id").select("start", "name")
    return pairs.join(starts, "start").select(F.col("text").alias("start"), "name")


def closed_rules(name: str, registry: dict[str, Rule] | None = None) -> list[Rule]:
    """The rules that a shortcut stands for."""
    registry = BUILT_IN if registry is None else registry
    return [registry[n] for n in reached(name, registry) if n in registry and registry[n].type != "shortcut"]


def check_fields(fields: DataFrame, rules: dict[str, list[Rule]], submitting: bool = False, include_empty: bool = False) -> DataFrame:
    """fields with errors: the messages of the rules of their name that they break. A rule of type match compares with
    the first field of that name in the form."""
    out = fields
    targets = sorted({str(r.value) for given in rules.values() for r in given if r.type == "match"})
    for target in targets:
        first = fields.where(F.col("name") == target).groupBy("form").agg(F.min_by("value", "pos").alias(f"__{target}"))
        out = out.join(first, "form", "left")
    messages = []
    for name, given in rules.items():
        for rule in given:
            other = F.col(f"__{rule.value}") if rule.type == "match" else None
            wrong = (F.col("name") == name) & looked_at(rule, F.col("value"), submitting, include_empty) & in_error(rule, F.col("value"), other)
            messages.append(F.when(wrong, F.lit(rule.message or f"{rule.name} failed")))
    found = F.array_compact(F.array(*messages)) if messages else F.array().cast("array<string>")
    return out.withColumn("errors", found).drop(*[f"__{t}" for t in targets])


def error_text(messages: Column, between: str = "</li><li>") -> Column:
    """Different messages in order, joined."""
    return F.array_join(F.array_sort(F.array_distinct(messages)), between)


def collect_errors(checked: DataFrame) -> DataFrame:
    """name and errors of the names that have any. Fields of one name merge by index: of two messages at an index, that
    of the earlier field stays."""
    at = checked.select("name", "pos", F.posexplode("errors").alias("i", "message")).groupBy("name", "i").agg(F.min_by("message", "pos").alias("message"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "message"))), lambda x: x["message"])
    return at.groupBy("name").agg(ordered.alias("errors"))


def has_errors(checked: DataFrame) -> DataFrame:
    """form and has_errors."""
    return checked.groupBy("form").agg(F.bool_or(F.size("errors") > 0).alias("has_errors"))


def checked_counts(fields: DataFrame, keys: list[str], checked: Column, least: int, most: int | None = None) -> DataFrame:
    """How many of each group are checked, and whether that is too few or too many."""
    n = F.count_if(checked)
    counts = fields.groupBy(*keys).agg(n.alias("n_checked")).withColumn("too_few", F.col("n_checked") < least)
    return counts if most is None else counts.withColumn("too_many", F.col("n_checked") > most)


def visible_inputs(fields: DataFrame, skipped: tuple[str, ...] = ("submit", "image")) -> DataFrame:
    return fields.where(~F.col("type").isin(*skipped)).where("visible")


def distinct_forms(fields: DataFrame) -> DataFrame:
    return fields.select("form").distinct()


def remote_checks(values: DataFrame, ask: Callable[[str], tuple[bool, str]]) -> DataFrame:
    """value, valid and message of each different value (column value), as `ask` says in a task; null is not asked.

    ask runs on the executors, for one value at a time; a value that it fails on counts as valid, as one without an
    answer does.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value in batch["value"]:
                try:
                    out.append((value, *ask(value)))
                except OSError:
                    out.append((value, True, ""))
            yield pd.DataFrame(out, columns=["value", "valid", "message"])

    return values.where("value is not null").select("value").distinct().mapInPandas(rows, "value string, valid boolean, message string")
