"""Scalar column expressions; everything here stays inside codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text layouts dates arrive in besides ISO-8601.
TIMESTAMP_PATTERNS = (
    "yyyy.MM.dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "MMM dd yyyy HH:mm:ss",
)

MICROS_PER_DAY = 86_400_000_000


def parse_ts(text: Column) -> Column:
    """Text to timestamp; anything unreadable becomes null.

    Spark would read a bare time of day as "today", so ISO parsing is tried only
    where the text starts with a year.
    """
    trimmed = F.trim(text)
    iso = F.when(trimmed.rlike("^[0-9]{4}"), F.try_to_timestamp(trimmed))
    return F.coalesce(iso, *[F.try_to_timestamp(trimmed, F.lit(p)) for p in TIMESTAMP_PATTERNS])


def to_number(value: Column) -> Column:
    """Cast to double; text that is no number, and NaN, become null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def micros(ts: Column) -> Column:
    """Timestamp as microseconds since 1970, the unit all time ranges use."""
    return F.unix_micros(ts.cast("timestamp"))


def age_days(ts: Column, as_of: Column, missing: float = 365.0) -> Column:
    """Whole days from ``ts`` to ``as_of``, rounded down; null gives ``missing``."""
    days = F.floor((micros(as_of) - micros(ts)) / F.lit(MICROS_PER_DAY))
    return F.coalesce(days.cast("double"), F.lit(float(missing)))


def clip(value: Column, low: float, high: float) -> Column:
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.when(value.isNotNull(), bounded)


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def max_norm(value: Column, maximum: Column) -> Column:
    """Share of the maximum, 0 where the maximum is not positive."""
    return F.when(maximum > 0, F.coalesce(value, F.lit(0.0)) / (maximum + F.lit(1e-9))).otherwise(0.0)


def email_domain(address: Column) -> Column:
    """Text after the last ``@``, null without one."""
    return F.when(F.instr(address, "@") > 0, F.substring_index(address, "@", -1))


def valid_ipv4(text: Column) -> Column:
    """True for four dot-separated numbers of 0 to 255; null counts as invalid."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return F.coalesce(text.rlike(rf"^{octet}(\.{octet}){{3}}$"), F.lit(False))


def hash_fraction(seed: int, *keys: Column) -> Column:
    """Uniform number in [0, 1) fixed by seed and key, equal on any engine with md5."""
    return hash_number(seed, *keys) / F.lit(float(1 << 32))


def hash_number(seed: int, *keys: Column, start: int = 1) -> Column:
    """32-bit number from 8 hex digits of ``md5("seed:key:...")``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), start, 8), 16, 10).cast("bigint")


def datetime_parts(ts: Column) -> dict[str, Column]:
    """Calendar parts; Monday is weekday 0."""
    return {
        "DAY": F.dayofmonth(ts),
        "MONTH": F.month(ts),
        "WEEKDAY": F.weekday(ts),
        "YEAR": F.year(ts),
    }


def text_counts(text: Column) -> dict[str, Column]:
    """Character count, and count of runs of non-blank characters."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " ")))
    return {
        "NUM_CHARACTERS": F.length(text),
        "NUM_WORDS": F.when(text.isNotNull(), words),
    }


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order; booleans, text and times are not numeric."""
    left_out = set(skip)
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in left_out]


def quoted(name: str) -> Column:
    """Column by its literal name, dots and brackets included."""
    return F.col(f"`{name.replace('`', '``')}`")


def clean_floats(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every float column, so missing has one form."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floats else quoted(c) for c in df.columns
    ])


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls by a constant, column by column, in one projection."""
    types = {f.name: f.dataType for f in df.schema}
    return df.select(*[
        F.coalesce(quoted(c), F.lit(values[c]).cast(types[c])).alias(c) if c in values else quoted(c)
        for c in df.columns
    ])


def sort_columns(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in sorted(df.columns)])


def drop_columns(df: DataFrame, names: Iterable[str] = (), suffix: str | None = None) -> DataFrame:
    """Leave out columns by name or by a common name ending."""
    gone = set(names)
    kept = [c for c in df.columns if c not in gone and not (suffix and c.endswith(suffix))]
    return df.select(*[quoted(c) for c in kept])


def protect_pii(df: DataFrame, columns: Iterable[str], *, hashed: bool = True, salt: str = "") -> DataFrame:
    """Replace personal columns by a salted SHA-256, or drop them."""
    personal = set(columns)
    if not hashed:
        return drop_columns(df, personal)
    return df.select(*[
        F.sha2(F.concat(F.lit(salt), quoted(c).cast("string")), 256).alias(c) if c in personal else quoted(c)
        for c in df.columns
    ])

