"""Name similarity on a 0-100 scale.

The default compares names with their words sorted, by insert/delete distance:
100 * (1 - distance / (len a + len b)). A replaced letter costs two."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..session import send_by_value

send_by_value(__name__)

SCORERS = ("token_sort_ratio", "ratio")


def comparison_form(name: Column, scorer: str) -> Column:
    """The text two names are compared by; equal forms score 100."""
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer!r}; choose one of {', '.join(SCORERS)}")
    if scorer == "token_sort_ratio":
        words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
        return F.array_join(F.array_sort(words), " ")
    return name


def _common_subsequence(a: str, b: str, places: dict[str, int]) -> int:
    """Length of the longest common subsequence, one machine word of ``a`` per letter of ``b``."""
    row = (1 << len(a)) - 1
    full = row
    for letter in b:
        hit = row & places.get(letter, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@pandas_udf(T.IntegerType())
def insert_delete_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    out = []
    last, places = None, {}
    for a, b in zip(left, right):
        if a != last:
            last, places = a, {}
            for i, letter in enumerate(a):
                places[letter] = places.get(letter, 0) | (1 << i)
        out.append(len(a) + len(b) - 2 * _common_subsequence(a, b, places))
    return pd.Series(out, dtype="int32")
