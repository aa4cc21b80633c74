"""Sources: JSON and text over HTTP, templates, JSON settings, file trees and form posts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.http import ask

MENU = (
    "category struct<name:string,short_name:string,special_instructions:string>, menu_items array<struct<short_name:string,"
    "name:string,description:string,price_small:double,price_large:double,small_portion_name:string,large_portion_name:string>>"
)

# The names of the greeting example, in order.
NAMES = ("Yaakov", "John", "Jen", "Jason", "Paul", "Frank", "Larry", "Paula", "Laura", "Jim")


def names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(NAMES)), "pos int, name string")


def fetch(urls: DataFrame, timeout: float = 30.0) -> DataFrame:
    """url, status and body of each url; the tasks ask. A failed request has status 0 and no body."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = ((url, *ask(url, timeout)) for url in batch["url"])
            yield pd.DataFrame([(url, status, body if status else "") for url, status, body in answers], columns=["url", "status", "body"])

    return urls.select("url").mapInPandas(rows, "url string, status int, body string")


def accepted(answers: DataFrame) -> DataFrame:
    """Answers with status 200; others give nothing."""
    return answers.where("status = 200")


def decoded(answers: DataFrame, schema: str, is_json: bool | None = None) -> DataFrame:
    """The accepted answers read as JSON (column data; a malformed one is an error) or, if is_json is False, as text."""
    good = accepted(answers)
    if is_json is False:
        return good.select("url", F.col("body").alias("data"))
    return good.select("url", F.from_json("body", schema, {"mode": "FAILFAST"}).alias("data"))


def handled(answers: DataFrame, handler: Callable[[DataFrame], DataFrame], schema: str = "", is_json: bool | None = None) -> DataFrame:
    """What a handler makes of the decoded answers; answers that are not accepted never reach it."""
    return decoded(answers, schema, is_json).transform(handler)


def menu_items(answers: DataFrame) -> DataFrame:
    """Items of menu answers with their category's short name."""
    menus = decoded(answers, MENU)
    return menus.select(F.col("data.category.short_name").alias("category"), F.posexplode("data.menu_items").alias("pos", "item")).select("category", "pos", "item.*")


def menu_url(base: str, short_name: Column) -> Column:
    """Where the items of a category are asked for; the name is not encoded."""
    return F.concat(F.lit(f"{base}?category="), short_name)


def templates(spark: SparkSession, path: str) -> DataFrame:
    """name and body of each file below a path; the body as it is, to its last line feed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*?)(\.[^.]*)?$", 1)
    return found.select(name.alias("name"), F.decode("content", "UTF-8").alias("body"))


def files(spark: SparkSession, path: str, pattern: str = "*", without: tuple[str, ...] = ()) -> DataFrame:
    """path, name and content of the files below a path whose name fits, but for those named in `without`."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    named = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return named.where(~F.col("name").isin(*without)) if without else named


def settings(spark: SparkSession, path: str) -> DataFrame:
    """One row of a JSON file."""
    return spark.read.option("multiLine", True).json(path)


def posts(lines: DataFrame, *fields: str) -> DataFrame:
    """The named fields of url-encoded form bodies (column body); null where a field was not sent."""
    pairs = F.str_to_map(F.coalesce("body", F.lit("")), F.lit("&"), F.lit("="))
    read = lambda name: F.url_decode(F.try_element_at(pairs, F.lit(name))).alias(name)
    return lines.select(*[read(name) for name in fields])
