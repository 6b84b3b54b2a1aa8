"""What several operators of this package share."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession

from skarn.operators.current import current_records

#: Letters that Unicode decomposition leaves whole.
_WHOLE = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i"})


def fold(text: str) -> str:
    """Without accents; letter case is kept."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(_WHOLE)) if not unicodedata.combining(c))


def osa(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, substitute, swap neighbours) from ``a`` to ``b``; ``most + 1`` when there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = 0
    m = min(len(a), len(b))
    while n < m and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def squash(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return current_records(table(spark, sf_dir, name), columns)
