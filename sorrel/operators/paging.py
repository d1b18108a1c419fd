"""Total order and keyset pagination."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import SORT_KEY

MAX_LIMIT, DEFAULT_LIMIT = 500, 100


@dataclass(frozen=True)
class Cursor:
    """The sort key of the last row that a page showed."""

    fqn: str
    uri: str
    line: int
    col: int

    def encode(self) -> str:
        body = json.dumps({"f": self.fqn, "u": self.uri, "l": self.line, "c": self.col}, separators=(",", ":"), ensure_ascii=False)
        return base64.urlsafe_b64encode(body.encode()).rstrip(b"=").decode()

    @staticmethod
    def decode(text: str) -> Cursor:
        try:
            raw = json.loads(base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True))
            got = Cursor(raw["f"], raw["u"], raw["l"], raw["c"])
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("malformed cursor") from e
        if not all(isinstance(v, k) and not isinstance(v, bool) for v, k in ((got.fqn, str), (got.uri, str), (got.line, int), (got.col, int))):
            raise ValueError("malformed cursor")
        return got


def clamp_limit(limit: int | None) -> int:
    return max(1, min(MAX_LIMIT, DEFAULT_LIMIT if limit is None else limit))


def sort_key(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in SORT_KEY]


def page(items: DataFrame, limit: int | None = None, cursor: Cursor | str | None = None) -> DataFrame:
    """The rows after ``cursor`` in the total order, up to the clamped limit, with ``has_more``.

    A heap of ``limit + 1`` rows a partition is all that moves. ``has_more`` says on each row whether
    another page follows; the last row's key is then that page's cursor.
    """
    n = clamp_limit(limit)
    if isinstance(cursor, str):
        cursor = Cursor.decode(cursor)
    if cursor:
        at = F.struct(F.lit(cursor.fqn).alias("a"), F.lit(cursor.uri).alias("b"), F.lit(cursor.line).cast("long").alias("c"), F.lit(cursor.col).cast("long").alias("d"))
        here = F.struct(*[c.alias(a) for c, a in zip(sort_key(), "abcd", strict=True)])
        items = items.where(here > at)
    shown = items.orderBy(*sort_key()).limit(n + 1)
    from pyspark.sql import Window

    whole = Window.partitionBy(F.lit(0))
    ranked = shown.withColumn("_at", F.row_number().over(whole.orderBy(*sort_key()))).withColumn("_n", F.count("*").over(whole))
    return ranked.where(F.col("_at") <= n).withColumn("has_more", F.col("_n") > n).drop("_at", "_n")


def next_cursor(rows: list) -> str | None:
    """The cursor behind collected page rows; None on the last page."""
    if not rows or not rows[-1]["has_more"]:
        return None
    last = rows[-1]
    return Cursor(last["fqn"], last["uri"], last["range_start_line"], last["range_start_col"]).encode()
