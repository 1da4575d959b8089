"""Small text, time and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the days of the week, starting with Monday.
SHORT_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
LONG_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def parse_time(text: Column) -> Column:
    """ISO time with any number of fraction digits, with or without ``Z``; finer than µs is cut off."""
    return F.try_to_timestamp(text)


def day_name(index: Column, names: tuple[str, ...] = SHORT_DAYS) -> Column:
    """0 .. 6 to a day name; null outside."""
    table = F.array(*[F.lit(n) for n in names])
    return F.when(index.between(0, 6), F.get(table, index))


def day_index(name: Column) -> Column:
    """Short or long day name to 0 (Monday) .. 6; null for any other text."""
    pairs = [F.lit(x) for names in (SHORT_DAYS, LONG_DAYS) for i, n in enumerate(names) for x in (n, i)]
    return F.element_at(F.create_map(*pairs), name)


def week_start(t: Column, zone: str) -> Column:
    """Instant of Monday midnight, in ``zone``, of the week that holds ``t``."""
    local = F.date_trunc("week", F.from_utc_timestamp(t, zone))
    return F.to_utc_timestamp(local, zone)


def java_string_hash(text: Column) -> Column:
    """The 32-bit polynomial hash of the JVM's strings, for text of the basic plane."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    wrap = F.lit(1 << 32)
    total = F.aggregate(
        codes,
        F.lit(0).cast("long"),
        lambda acc, c: F.pmod(acc * 31 + c, wrap),
    )
    return F.when(total >= (1 << 31), total - wrap).otherwise(total)


def sample_key(*cols: Column) -> Column:
    """Uniform, repeatable sort key of a row."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))


def tokens(text: Column) -> Column:
    """Case-folded words of a text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
