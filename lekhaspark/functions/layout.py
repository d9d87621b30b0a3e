"""Pages printed in two columns: the gutter is found in the ink of all lines at once, the split is array work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .text import let

# What counts as two columns.
LEAST_LINES = 8
PAGE_WIDTH, HALF_WIDTH = 60, 30
GUTTER_FROM, GUTTER_TO = 0.30, 0.70
MOST_BLOCKED, LEAST_BOTH = 0.15, 0.35
GAP = 3
LEAST_PAGES, LEAST_SHARE = 3, 0.40


def _ink(page: str) -> np.ndarray:
    """Lines by columns: where something is printed."""
    lines = page.split("\n")
    codes = np.array([x.ljust(max(map(len, lines), default=0)) for x in lines], dtype=np.str_)
    width = codes.dtype.itemsize // 4
    return ~np.isin(codes.view(np.uint32).reshape(len(lines), width), SPACES) if width else np.zeros((len(lines), 0), bool)


SPACES = np.array([*range(9, 14), 0, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)


def _best_column(ink: np.ndarray, least_width: int) -> int | None:
    """The column inside the middle of the page at which few lines have ink and most have it on both sides."""
    ink = ink[ink.any(axis=1)]
    n = len(ink)
    used = np.flatnonzero(ink.any(axis=0))
    width = int(used[-1]) + 1 if len(used) else 0
    if n < LEAST_LINES or width < least_width:
        return None
    sums = np.zeros((n, width + GAP + 1), np.int32)
    sums[:, 1 : width + 1] = np.cumsum(ink[:, :width], axis=1)
    sums[:, width + 1 :] = sums[:, width : width + 1]
    column = np.arange(int(width * GUTTER_FROM), int(width * GUTTER_TO) + 1)
    column = column[column > 0]
    before, through = sums[:, column - 1], sums[:, np.minimum(column - 1 + GAP, width)]
    free = before == through
    both = (free & (sums[:, column] > 0) & (sums[:, -1:] > through)).sum(axis=0)
    good = ((~free).sum(axis=0) <= MOST_BLOCKED * n) & (both >= LEAST_BOTH * n)
    return int(column[np.argmax(np.where(good, both, -1))]) if good.any() else None


def find_gutter(page: str) -> int | None:
    ink = _ink(page)
    column = _best_column(ink, PAGE_WIDTH)
    # a half that splits again is part of a table
    if column is None or any(_best_column(half, HALF_WIDTH) is not None for half in (ink[:, :column], ink[:, column:])):
        return None
    return column


@F.pandas_udf(IntegerType())
def gutter(s: pd.Series) -> pd.Series:
    """Column of the gutter of a page printed in two columns; null for one column and for tables."""
    return s.map(lambda x: find_gutter(x) if x else None).astype("Int32")


def split_at(page: Column, column: Column) -> Column:
    """The left column, an empty line, the right column; lines with ink in the gutter stay whole, with the left."""
    across = lambda x: F.trim(F.substr(x, column, F.lit(GAP))) != ""

    def halves(lines: Column) -> Column:
        left = F.transform(lines, lambda x: F.when(across(x), x).otherwise(F.rtrim(F.substr(x, F.lit(1), column))))
        right = F.transform(F.filter(lines, lambda x: ~across(x)), lambda x: F.trim(F.substr(x, column + 1, F.length(x))))
        return F.concat(F.array_join(left, "\n"), F.lit("\n\n"), F.array_join(right, "\n"))

    return F.when(column.isNull(), page).otherwise(let(F.split(page, "\n"), halves))


def one_column(page: Column) -> Column:
    """A page with its two columns one after the other; other pages as they are, null stays null."""
    return let(F.struct(page.alias("p"), gutter(page).alias("g")), lambda x: split_at(x["p"], x["g"]))


def reflow(pages: DataFrame, document: str, text: str) -> DataFrame:
    """pages with `text` put into one column in documents that are printed so: LEAST_PAGES pages at least, LEAST_SHARE of them with a gutter."""
    found = pages.withColumn("_gutter", gutter(F.col(text)))
    share = found.groupBy(document).agg(((F.count("*") >= LEAST_PAGES) & (F.count("_gutter") >= LEAST_SHARE * F.count("*"))).alias("_columns")).withColumnRenamed(document, "_document")
    met = found.join(share, F.col(document).eqNullSafe(F.col("_document")), "left")
    return met.select(*[split_at(found[c], F.when(F.col("_columns"), F.col("_gutter"))).alias(c) if c == text else found[c] for c in pages.columns])
