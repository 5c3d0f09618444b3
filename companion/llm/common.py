"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token class of the size and shingle contracts: everything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def byte_rows(texts: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of every row of an Arrow string column (nulls stay None)."""
    return texts.cast(pa.binary()).to_pylist()


def text_column(df: DataFrame, name: str = "text") -> Column:
    """``df``'s text as string, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, whatever the other letters."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def md5_fraction(*cols: Column, seed: int) -> Column:
    """A uniform draw in [0, 1) that depends on the row's values and ``seed`` only
    (52 bits of a digest, so other engines can repeat it)."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_fraction(col: Column) -> Column:
    """The same from Spark's own hash: cheaper, for draws that only Spark makes."""
    return F.shiftrightunsigned(F.xxhash64(col), 11).cast("double") / F.lit(float(1 << 53))
