"""Whole flows: a menu page, a contact form and the build of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import fill, first_name, with_suffix
from quillon.operators.predicates import BUILT_IN, Rule, mail_address, present
from quillon.operators.templates import category_tile, fold, item_tile
from quillon.operators.validate import check_fields, has_errors

CONTACT_RULES: dict[str, list[Rule]] = {
    "name": [BUILT_IN["required"]],
    "email": [BUILT_IN["required"], BUILT_IN["validemail"]],
    "phone": [BUILT_IN["required"]],
    "message": [BUILT_IN["required"]],
}


def categories_page(categories: DataFrame) -> DataFrame:
    """One row html from categories (pos, name, short_name)."""
    return fold(categories.withColumn("page", F.lit(1)), ["page"], "pos", category_tile(F.col("name"), F.col("short_name")), "<section>", "</section>", "")


def menu_page(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys and html from items with the columns of a menu item."""
    shown = {k: F.col(k) for k in ("short_name", "name", "description", "price_small", "price_large", "small_portion", "large_portion")}
    return fold(items, keys, order, item_tile(shown), "<section>", "</section>")


def submitted(fields: DataFrame) -> DataFrame:
    """Records (form, name, email, phone, message, first_name) of the contact forms without errors, client side then server side."""
    checked = check_fields(fields, CONTACT_RULES, submitting=True)
    good = has_errors(checked).where("not has_errors").select("form")
    parts = [F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in CONTACT_RULES]
    records = fields.join(good, "form", "left_semi").groupBy("form").agg(*parts)
    return records.where(present(F.col("name")) & present(F.col("email")) & present(F.col("phone")) & present(F.col("message"))).where(
        mail_address(F.col("email"))
    ).withColumn("first_name", first_name(F.col("name")))


def built(files: DataFrame, banner: str, version: str, year: int) -> DataFrame:
    """path and content of text files with a banner, and again without runs of white space as .min files."""
    head = fill(F.lit(banner), version=F.lit(version), year=F.lit(year))
    plain = files.select("path", F.concat(head, "content").alias("content"))
    small = plain.select(with_suffix(F.col("path"), ".min").alias("path"), F.regexp_replace("content", r"\s+", " ").alias("content"))
    return plain.unionByName(small)
