"""How alike two short forms sound when read as letters: a ratio of matching blocks, in Arrow batches."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@lru_cache(maxsize=1 << 16)
def _letters(text: str) -> tuple[str, str]:
    """The letters and digits of the compatibility form without case, and its other characters but spaces."""
    whole = unicodedata.normalize("NFKC", text)
    return "".join(c for c in whole.casefold() if c.isalnum()), "".join(c for c in whole if not (c.isalnum() or c.isspace()))


def similarity(left: str | None, right: str | None) -> float:
    """0 without letters, or where letters agree and symbols don't; else twice the matched characters over all. The order of the two matters."""
    (a, x), (b, y) = _letters(left or ""), _letters(right or "")
    if not (a and b) or (a == b and x != y):
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@pandas_udf(DoubleType())
def similarities(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similarity(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")
