"""MMSI tests and lookups."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.constants import EXCLUDED_MMSI, EXCLUDED_PREFIXES


def mid(mmsi: Column | str) -> Column:
    """First three digits of the number as written; leading zeros are already lost in an integer."""
    c = F.col(mmsi) if isinstance(mmsi, str) else mmsi
    return F.substring(c.cast("string"), 1, 3)


def is_station(mmsi: Column | str, padded: bool = False) -> Column:
    """Coast station (00) or aid to navigation (99); padded=True restores the nine digits first."""
    c = (F.col(mmsi) if isinstance(mmsi, str) else mmsi).cast("string")
    if padded:
        c = F.lpad(c, 9, "0")
    return c.startswith("00") | c.startswith("99")


def is_excluded(
    mmsi: Column | str,
    prefixes: list[str] = EXCLUDED_PREFIXES,
    numbers: list[int] = EXCLUDED_MMSI,
) -> Column:
    """True for listed prefixes and numbers; a null MMSI is not excluded."""
    c = F.col(mmsi) if isinstance(mmsi, str) else mmsi
    text = c.cast("string")
    tests = [c.isin(list(numbers))] if numbers else []
    for length in sorted({len(p) for p in prefixes}):
        tests.append(F.substring(text, 1, length).isin([p for p in prefixes if len(p) == length]))
    excluded = F.lit(False)
    for test in tests:
        excluded = excluded | test
    return F.coalesce(excluded, F.lit(False))


def mmsi_of_track_file(name: Column | str) -> Column:
    """Number after the last underscore of a track file name."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_extract(c, r"_([^_.]+)\.[^_]*$", 1)
