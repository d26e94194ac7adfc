"""Turning a reading into OK, WARNING, CRITICAL or UNKNOWN."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# State -> code reported to the monitoring system.
CODES = {"OK": 0, "WARNING": 1, "CRITICAL": 2, "UNKNOWN": 3}


def _limit(value) -> Column:
    """A threshold given as a number, or as the name of a column that holds it."""
    return F.col(value) if isinstance(value, str) else F.lit(value)


def classify(value: Column, warn, crit, *, low_is_bad: bool = False, negative_is_critical: bool = False) -> Column:
    """The state of a reading; UNKNOWN where there is none, or no threshold to hold it against."""
    warn, crit = _limit(warn), _limit(crit)
    critical = value <= crit if low_is_bad else value >= crit
    warning = value <= warn if low_is_bad else value >= warn
    if negative_is_critical:
        critical = (value < 0) | critical
    unknown = value.isNull() | warn.isNull() | crit.isNull()
    return F.when(unknown, "UNKNOWN").when(critical, "CRITICAL").when(warning, "WARNING").otherwise("OK")


def code(state: str | Column) -> Column:
    state = F.col(state) if isinstance(state, str) else state
    return F.coalesce(*[F.when(state == s, F.lit(c).cast("bigint")) for s, c in CODES.items()])


def message(state: str, label: str, value: Column, warn, crit) -> Column:
    """``STATE: label: value/threshold`` in whole numbers; the threshold that the state is about."""
    limit = F.when(F.col(state) == "CRITICAL", _limit(crit)).otherwise(_limit(warn))
    numbers = F.concat_ws("/", *[x.cast("bigint").cast("string") for x in (value, limit)])
    known = F.concat(F.col(state), F.lit(f": {label}: "), numbers)
    return F.when(F.col(state) == "UNKNOWN", f"UNKNOWN: {label}").otherwise(known)
