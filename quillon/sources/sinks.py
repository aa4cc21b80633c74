"""Sinks: a target that is overwritten, two outputs of one lineage, lines, and records that are sent away."""

from __future__ import annotations

import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quillon.functions.text import escape_html, strip_tags


def overwrite(rows: DataFrame, path: str) -> None:
    """Replace what is at a path."""
    rows.write.mode("overwrite").parquet(path)


def append_lines(lines: Column, rows: DataFrame, path: str) -> None:
    rows.select(lines.alias("value")).write.mode("append").text(path)


def tee(rows: DataFrame, plain: str, changed: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Write rows, and what change makes of them, from one evaluation."""
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        overwrite(held, plain)
        overwrite(change(held), changed)
    finally:
        held.unpersist()


def mail(record: DataFrame, sender: str, *keys: str) -> DataFrame:
    """keys, subject, body and headers of messages for records (name, email, phone, message); line feeds cannot enter headers."""
    clean = {c: strip_tags(escape_html(F.col(c))) for c in ("name", "email", "phone", "message")}
    flat = {c: F.regexp_replace(v, r"[\r\n]+", " ") for c, v in clean.items()}
    # fixed values: the wording of the message
    body = F.format_string(
        "You have received a new message from your website contact form.\n\nHere are the details:\n\nName: %s\n\nEmail: %s\n\nPhone: %s\n\nMessage:\n%s",
        clean["name"], clean["email"], clean["phone"], clean["message"],
    )
    return record.select(
        *keys,
        F.concat(F.lit("Website Contact Form:  "), flat["name"]).alias("subject"),
        body.alias("body"),
        F.concat(F.lit(f"From: {sender}\nReply-To: "), flat["email"]).alias("headers"),
    )


def post_each(url: str, timeout: float = 30.0) -> Callable[[Iterable[Row]], None]:
    """For DataFrame.foreachPartition: send each row as a form post; an answer other than 200 fails the task."""

    def send(rows: Iterable[Row]) -> None:
        for row in rows:
            data = urllib.parse.urlencode({k: "" if v is None else v for k, v in row.asDict().items()}).encode()
            with urllib.request.urlopen(urllib.request.Request(url, data=data), timeout=timeout) as answer:
                if answer.status != 200:
                    raise OSError(f"{url} answered {answer.status}")

    return send


def post_batches(url: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch."""
    return lambda batch, _: batch.foreachPartition(post_each(url))
