"""Free-text periods as year intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A year, or a range whose end may be open; up to a year; a decade.
_PERIOD = r"(?i)^(?:(?:c\.|ca\.)?\s*(\d{4})(?:\s*(-)\s*(\d{4})?)?|-\s*(\d{4})|(?:anos|d[ée]cada de)\s+(\d{4}))$"


def parse(period: Column) -> Column:
    """struct(first, last): years, either null where open; null if the text is no period."""
    p = F.trim(period)
    part = lambda g: F.nullif(F.regexp_extract(p, _PERIOD, g), F.lit(""))
    decade_ = (F.floor(part(5).cast("int") / 10) * 10).cast("int")
    first = F.coalesce(part(1).cast("int"), decade_)
    last = F.coalesce(part(3).cast("int"), part(4).cast("int"), decade_ + 9, F.when(part(2).isNull(), part(1).cast("int")))
    return F.when(p.rlike(_PERIOD), F.struct(first.alias("first"), last.alias("last")))


def effective(interval: Column) -> Column:
    """The interval with an open side closed at the known year."""
    return F.when(interval.isNotNull(), F.struct(F.coalesce(interval["first"], interval["last"]).alias("first"), F.coalesce(interval["last"], interval["first"]).alias("last")))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")
