"""Parsers of names, flags and configuration values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODECS, POLICIES, ASSIGNORS = ("none", "lz4", "zstd"), ("delete", "compact", "compact,delete"), ("range", "roundrobin", "sticky", "cooperative-sticky")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_of(c, known: tuple[str, ...]) -> Column:
    """The lower-cased, trimmed name if it is known, else null."""
    name = F.lower(F.trim(_col(c)))
    return F.when(name.isin(*known), name)


def codec_of(attributes) -> Column:
    """Bits 0 to 2 of a batch's attributes; the reserved ones, 3 to 7, name no codec (null)."""
    return F.get(F.array(*[F.lit(x) for x in CODECS]), _col(attributes).bitwiseAND(7).cast("int"))


def is_transactional(attributes) -> Column:
    return _col(attributes).bitwiseAND(8) != 0


def is_control(attributes) -> Column:
    return _col(attributes).bitwiseAND(16) != 0


def optional_long(c) -> Column:
    """A whole number that isn't negative; empty and anything else is null."""
    v = F.trim(_col(c)).try_cast("long")
    return F.when(v >= 0, v)
