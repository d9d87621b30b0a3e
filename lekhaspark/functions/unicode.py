"""Unicode forms and invisible characters. Spark has no normal forms, so these two run in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that names carry without being seen.
JOINERS = "‌‍"
INVISIBLE = "​‌‍﻿"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed form; null stays null."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Composed compatibility form; null stays null."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normal_text(c: Column) -> Column:
    """NFC with line ends unified, blanks collapsed, at most one empty line, ends trimmed."""
    from .text import normalize_space

    return normalize_space(nfc(c))


def match_form(c: Column) -> Column:
    """NFKC, lower case, letters, marks and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(nfkc(c)), r"[^\p{L}\p{M}\p{N}]+", " "))


def strip_nul(c: Column) -> Column:
    return F.regexp_replace(c, "\x00", "")


def strip_joiners_and_space(c: Column) -> Column:
    """A name without joiners, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, JOINERS, ""), r"\s+", " "))


def department_key(c: Column) -> Column:
    """Grouping key of a name: NFC, without invisible characters, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(nfc(c), INVISIBLE, ""), r"\s+", " ")))


def department_id(source_id: Column) -> Column:
    """The second part of an id of the form number#department#section#year, else null."""
    return F.when(source_id.rlike(r"^\d+#\d+#\d+#\d{4}$"), F.regexp_extract(source_id, r"^\d+#(\d+)#", 1).cast("long"))
