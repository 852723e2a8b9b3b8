"""128-bit identifiers as two longs, and a permutation of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A UUID in any usual spelling: case, white space around it, urn:uuid:, braces, with or without hyphens.
UUID_SPELLING = r"^\s*(urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?\s*$"
#: The usual one.
_USUAL = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def uuid_hex(text: Column) -> Column:
    """The 32 lower-case hexadecimal digits of a UUID, null if the text is none."""
    low = F.lower(text)
    usual = (F.length(text) == 36) & text.rlike(_USUAL)
    return F.when(usual, F.replace(low, F.lit("-"), F.lit(""))).when(low.rlike(UUID_SPELLING), F.translate(F.replace(low, F.lit("urn:uuid:"), F.lit("")), "{}- \t\r\n\f\x0b", ""))


def hex_halves(hex32: Column) -> tuple[Column, Column]:
    """32 hexadecimal digits as two longs (bit patterns)."""
    word = lambda at: F.conv(F.substring(hex32, at, 16), 16, -10).cast("bigint")
    return word(1), word(17)


def permuted(df: DataFrame, high: str, low: str) -> DataFrame:
    """Columns high and low (longs) put through a bijection of 128-bit values, a Feistel network of three rounds: equal outputs mean
    equal inputs, and every bit of the first half depends on all of the identifier. Nulls stay null."""
    for half, other, seed in ((low, high, 1), (high, low, 2), (low, high, 3)):  # a projection each, so that nothing is computed twice
        df = df.withColumn(half, F.col(half).bitwiseXOR(F.xxhash64(other, F.lit(seed))))
    return df
