"""Random numbers from keys: the same on every run, in every engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """A whole number below 2^32 from the parts; strings name columns, numbers are themselves."""
    texts = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A double within (0, 1), never its ends."""
    return (draw(*parts) + 0.5) / float(1 << 32)
