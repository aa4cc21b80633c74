"""Field predicates and their registry.

A predicate is true where a value is in error. Each type takes the value and the parameter of its rule; with negative, a
rule asks for the opposite. Patterns hold for the whole value and are anchored as text: '^' + pattern + end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import number_at_start
from quillon.operators.ordered import states_in_order

# Patterns, names and messages of the built-in rules.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,4}"
NUMBER = r"([+-]?\d+(\.\d*)?([eE][+-]?[0-9]+)?)?"
INTEGER = r"[+-]?\d+"


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    value: object = None
    message: str = ""
    negative: bool = False


BUILT_IN = {
    "email": Rule("Email", "shortcut", "validemail"),
    "validemail": Rule("Validemail", "regex", EMAIL, "Not a valid email address"),
    "passwordagain": Rule("Passwordagain", "match", "password", "Does not match the given password"),
    "positive": Rule("Positive", "shortcut", "number,positivenumber"),
    "negative": Rule("Negative", "shortcut", "number,negativenumber"),
    "number": Rule("Number", "regex", NUMBER, "Must be a number"),
    "integer": Rule("Integer", "regex", INTEGER, "No decimal places allowed"),
    "positivenumber": Rule("Positivenumber", "min", 0, "Must be a positive number"),
    "negativenumber": Rule("Negativenumber", "max", 0, "Must be a negative number"),
    "required": Rule("Required", "required", None, "This is required"),
    "checkone": Rule("Checkone", "minchecked", 1, "Check at least one option"),
}

#: Types that are looked at when a form is sent, for empty values too.
ON_SUBMIT = ("required", "match", "minchecked", "maxchecked")


def matches(value: Column, pattern: str) -> Column:
    """Whether the whole value matches; an alternative at the top of the pattern keeps its own anchor only."""
    return F.regexp_like(value, F.lit(f"^{pattern}\\z"))


def _number(value: Column) -> Column:
    return F.coalesce(number_at_start(value), F.lit(None).cast("double"))


TYPES: dict[str, Callable[[Column, object], Column]] = {
    "regex": lambda v, p: ~matches(v, str(p)),
    "required": lambda v, _: F.length(v) == 0,
    "match": lambda v, other: ~v.eqNullSafe(other),
    # a value that is no number is never in error
    "max": lambda v, p: F.coalesce(_number(v) > F.lit(float(p)), F.lit(False)),
    "min": lambda v, p: F.coalesce(_number(v) < F.lit(float(p)), F.lit(False)),
    "maxlength": lambda v, p: F.length(v) > F.lit(int(p)),
    "minlength": lambda v, p: F.length(v) < F.lit(int(p)),
    "maxchecked": lambda n, p: n > F.lit(int(p)),
    "minchecked": lambda n, p: n < F.lit(int(p)),
}

Callback = Callable[[pd.Series], pd.Series]


def register_callback(spark: SparkSession, name: str, function: Callback | str) -> None:
    """A predicate of the user's own, under a name that may have dots, as a function of the session.

    function: SQL over the text `value`, which stays in the plan, or a function of whole columns, which runs on Arrow batches.
    """
    if isinstance(function, str):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{name}`(value STRING) RETURNS BOOLEAN RETURN {function}")
    else:
        spark.udf.register(name, F.pandas_udf(function, "boolean"))


def called(names: list[str], name: Column, value: Column) -> Column:
    """The callback that a column names, of a value; an error for a name that is not among those given."""
    found = F.raise_error(F.concat(F.lit("no callback named "), F.coalesce(name, F.lit("null")))).cast("boolean")
    for known in names:
        found = F.when(name == known, F.call_function(f"`{known}`", value)).otherwise(found)
    return found


def override(registry: dict[str, Rule], **changes: dict) -> dict[str, Rule]:
    """A registry with some rules changed or added; fields that are not named stay."""
    found = dict(registry)
    for name, fields in changes.items():
        found[name] = replace(found[name], **fields) if name in found else Rule(**({"name": name.title()} | fields))
    return found


def in_error(rule: Rule, value: Column, other: Column | None = None) -> Column:
    """Whether a value breaks a rule; other: the value to match, for rules of type 'match'."""
    if rule.type == "callback":
        wrong = F.call_function(f"`{rule.value}`", value)
    else:
        wrong = TYPES[rule.type](value, other if rule.type == "match" else rule.value)
    return wrong != F.lit(rule.negative) if rule.negative else wrong


def looked_at(rule: Rule, value: Column, submitting: bool = False, include_empty: bool = False) -> Column:
    """Whether a rule is looked at: for an empty value only if asked for, or on sending for some types."""
    if include_empty or submitting and rule.type in ON_SUBMIT:
        return F.lit(True)
    return F.coalesce(F.length(value) > 0, F.lit(False))


def present(value: Column) -> Column:
    """Whether a sent field has content: null, '' and '0' have none."""
    return ~F.coalesce(value, F.lit("")).isin("", "0")


def mail_address(value: Column) -> Column:
    """The server's check of an address: one @, a local part without blanks or doubled dots, a host with a dot."""
    return F.regexp_like(value, F.lit(r"^(?!\.)(?!.*\.\.)[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]{1,64}(?<!\.)@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z0-9-]{1,63}\z"))


def affix_state(
    state: Column, scroll: Column, position: Column, unpin: Column, height: Column, view: Column, total: Column, offset_top: Column, offset_bottom: Column
) -> Column:
    """Where an element of a height stands in a view that is scrolled over a page of total height: 'top', 'bottom' or ''.

    state is where it stood before (null: it is asked for the first time), position where it is on the page, unpin how far
    from the view's upper edge it was when it came to the bottom. Either offset can be null.
    """
    bound = total - offset_bottom
    first = state.isNull()
    top, bottom, none = F.lit("top"), F.lit("bottom"), F.lit("")
    reaches = F.when(first, scroll + view >= bound).otherwise(position + height >= bound)
    leaves = F.when(offset_top.isNotNull(), scroll + unpin <= position).otherwise(scroll + view <= bound)
    return (
        F.when((state == "top") & offset_top.isNotNull(), F.when(scroll < offset_top, top).otherwise(none))
        .when(state == "bottom", F.when(leaves, none).otherwise(bottom))
        .when(scroll <= offset_top, top)
        .when(reaches, bottom)
        .otherwise(none)
    )


def affix_states(rows: DataFrame, key: str, order: str, unpin: float, height: float, view: float, total: float, offset_top: float | None, offset_bottom: float | None) -> DataFrame:
    """key, order and state of each row (scroll, position), where each state follows from the one before it in its group, however
    long the group is."""
    fixed = [F.lit(x).cast("double") for x in (unpin, height, view, total, offset_top, offset_bottom)]
    scroll, position = F.col("scroll").cast("double"), F.col("position").cast("double")
    found = states_in_order(rows, key, order, lambda state: affix_state(state, scroll, position, *fixed), (None, "", "top", "bottom"))
    return found.select(key, order, "state")


def width_class(width: Column) -> Column:
    """Three classes of screen width."""
    return F.when(width >= 992, F.lit("desktop")).when(width >= 768, F.lit("tablet")).otherwise(F.lit("mobile"))


def grid_class(width: Column) -> Column:
    """Five classes of screen width, the narrowest within the fourth."""
    return (
        F.when(width >= 1200, F.lit("lg")).when(width >= 992, F.lit("md")).when(width >= 768, F.lit("sm"))
        .when(width >= 480, F.lit("xs")).otherwise(F.lit("xxs"))
    )
