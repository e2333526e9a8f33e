"""Order-independent randomness: every draw is a pure function of its keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def keyed_hash(*parts: Column | str | int) -> Column:
    """Hex SHA-256 of the parts joined by the unit separator; a NULL part keeps its place."""
    columns = [F.coalesce(p.cast("string"), F.lit("\x00")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(SEPARATOR, *columns), 256)


def hash_int(hex_digest: Column, start: int = 1, digits: int = 15) -> Column:
    """``digits`` hex characters of a digest as a BIGINT (at most 15, so it stays positive)."""
    return F.conv(F.substring(hex_digest, start, digits), 16, 10).cast("bigint")


def hash_uniform(hex_digest: Column) -> Column:
    """A number in [0, 1) from the first 13 hex characters (52 bits)."""
    return hash_int(hex_digest, 1, 13).cast("double") / F.lit(float(2**52))


def tie_key(item: Column) -> Column:
    """Order among rows with equal values: 60 bits of the item's hash. A table has no row order to
    fall back on, and a hash leaves no group of ties in one place."""
    return hash_int(F.sha2(item.cast("string"), 256))
