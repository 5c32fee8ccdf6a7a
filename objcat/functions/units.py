"""Sizes, ages and instants: parsing and printing as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from objcat.schema import as_col

_LONG_MAX = 2**63 - 1

# Seconds per age suffix (case matters: m is a minute, M a month of 30 days).
AGE_SECONDS = {
    "ms": 0.001,
    "s": 1.0,
    "m": 60.0,
    "h": 3600.0,
    "d": 86400.0,
    "w": 604800.0,
    "M": 2592000.0,
    "y": 31536000.0,
    "": 1.0,
}

# Suffixes of a relative instant.
RELATIVE_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}

# Unit names of a printed size.
IEC_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
SI_UNITS = ["B", "kB", "MB", "GB", "TB", "PB", "EB"]

# Hex length of a digest.
HEX_LENGTH = {"blake3": 64, "sha1": 40, "sha256": 64}

# A number with an exponent, or a word for infinity or not-a-number.
_FLOAT = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


def size_multipliers() -> dict[str, float]:
    """Every accepted suffix in lower case: `k`, `ki`, `kib` are binary, `kb` is decimal, up to peta."""
    table = {"": 1.0, "b": 1.0}
    for power, letter in enumerate("kmgtp", start=1):
        for suffix in (letter, letter + "i", letter + "ib"):
            table[suffix] = 1024.0**power
        table[letter + "b"] = 1000.0**power
    return table


def _table(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def parse_size(col: Column | str) -> Column:
    """struct(bytes, unlimited, problem). `off` and a bare `0` mean no limit; a bare number is bytes."""
    col = as_col(col)
    number = F.regexp_extract(col, r"(?Us)^\s*([^A-Za-z]*?)\s*(?:[A-Za-z].*)?$", 1)
    suffix = F.lower(F.regexp_extract(col, r"(?Us)^[^A-Za-z]*(.*?)\s*$", 1))
    value = number.try_cast("double")
    factor = F.try_element_at(_table(size_multipliers()), suffix)
    unlimited = ((number == "") & (suffix == "off")) | ((number == "0") & (suffix == ""))
    problem = (
        F.when(unlimited, F.lit(None).cast("string"))
        .when(value.isNull(), F.lit("invalid"))
        .when(value < 0, F.lit("negative"))
        .when(factor.isNull(), F.lit("unknown-suffix"))
    )
    size = F.when(~unlimited & (value >= 0), F.floor(value * factor))
    parsed = F.struct(size.alias("bytes"), unlimited.alias("unlimited"), problem.alias("problem"))
    return F.when(col.isNotNull(), parsed)


def parse_age(col: Column | str) -> Column:
    """struct(seconds, unlimited, problem). A bare number is seconds; 0 and `off` mean no limit."""
    col = as_col(col)
    shape = r"(?Us)^\s*(.+?)\s*(ms|s|m|h|d|w|M|y)?\s*$"
    number, suffix = F.regexp_extract(col, shape, 1), F.regexp_extract(col, shape, 2)
    value = F.when(number.rlike(_FLOAT), number).try_cast("double")
    seconds = value * F.try_element_at(_table(AGE_SECONDS), suffix)
    # Not-a-number counts as larger than every number, so it ends as "no limit" like infinity does.
    endless = (value == 0) | ((value > 0) & (seconds >= float(_LONG_MAX)))
    unlimited = ((F.lower(number) == "off") & (suffix == "")) | F.coalesce(endless, F.lit(False))
    problem = (
        F.when(unlimited, F.lit(None).cast("string"))
        .when(value.isNull(), F.lit("invalid"))
        .when(value < 0, F.lit("negative"))
    )
    # A span is kept to the nanosecond before its whole seconds are taken.
    whole = F.when(~unlimited & (value > 0), F.floor(seconds + 0.5e-9))
    parsed = F.struct(whole.alias("seconds"), unlimited.alias("unlimited"), problem.alias("problem"))
    return F.when(col.isNotNull(), parsed)


def format_bytes(col: Column | str, units: str = "iec") -> Column:
    """`N B` below one unit; then two decimals under 10 and one decimal above, ties to even.

    The scaled value is split into whole and fractional part, and the fraction is rounded as a count of
    2^-52: that is exact, where `format_string` rounds the shortest decimal spelling and may differ. Both
    spellings are made and one is picked, so that what they share is worked out once per row.
    """
    col = as_col(col)
    names, base = (IEC_UNITS, 1024.0) if units == "iec" else (SI_UNITS, 1000.0)
    scaled = [col.cast("double")]
    for _ in names[1:]:
        scaled.append(scaled[-1] / base)
    value, unit = scaled[-1], F.lit(names[-1])
    for power in range(len(names) - 2, 0, -1):
        fits = scaled[power] < base
        value, unit = F.when(fits, scaled[power]).otherwise(value), F.when(fits, F.lit(names[power])).otherwise(unit)

    whole = F.floor(value)
    fraction = ((value - whole) * float(2**52)).cast("long")
    places = F.when(value < 10.0, F.lit(2)).otherwise(F.lit(1))
    scale = F.when(value < 10.0, F.lit(100)).otherwise(F.lit(10)).cast("long")
    rest = (fraction * scale).bitwiseAND(F.lit(2**52 - 1))
    count = whole * scale + F.shiftright(fraction * scale, 52)
    # Up when the rest is over a half, or is a half and the count is odd.
    count = count + (rest + count % 2 > F.lit(2**51)).cast("long")
    spelled = F.concat(
        F.call_function("div", count, scale).cast("string"),
        F.lit("."),
        F.lpad((count % scale).cast("string"), places, F.lit("0")),
        F.lit(" "),
        unit,
    )
    plain = F.concat(col.cast("string"), F.lit(" " + names[0]))
    return F.get(F.array(plain, spelled), F.when(col < int(base), F.lit(0)).otherwise(F.lit(1)))


def _div(value: Column, by: int) -> Column:
    """Whole-number quotient of a non-negative value, without going through a double."""
    return F.call_function("div", value, F.lit(by).cast("long"))


def rfc3339(col: Column | str) -> Column:
    """Unix seconds as `YYYY-MM-DDTHH:MM:SSZ`, before 1970 too, whatever the session time zone."""
    col = as_col(col).cast("long")
    second = F.pmod(col, F.lit(86400).cast("long"))
    day = F.call_function("div", col - second, F.lit(86400).cast("long")).cast("int")

    def two(value: Column) -> Column:
        return F.lpad(value.cast("string"), 2, "0")

    return F.concat(
        F.date_from_unix_date(day).cast("string"),
        F.lit("T"),
        two(_div(second, 3600)),
        F.lit(":"),
        two(_div(second % 3600, 60)),
        F.lit(":"),
        two(second % 60),
        F.lit("Z"),
    )


def parse_time(col: Column | str, now: int | Column = 0) -> Column:
    """Unix seconds of `now`, `@unix`, `2d` ago, a calendar date, or a date with a clock and an offset; else NULL.

    Clocks are UTC unless they carry an offset; years run from 1970 to 9999; second 60 is accepted. One
    pattern takes a calendar time apart into a list. Text, list and zone are bound, as an expression that stands in
    many places is worked out in each; only the reading that fits is worked out.
    """
    now = F.lit(now).cast("long") if isinstance(now, int) else now.cast("long")
    ago = r"^\+?([0-9]+)([smhdw])$"

    def read(text: Column) -> Column:
        absolute = F.regexp_extract(text, r"^@(?U:\s*)([+-]?[0-9]+)$", 1).try_cast("long")
        step = F.try_element_at(_table(RELATIVE_SECONDS), F.regexp_extract(text, ago, 2)).cast("long")
        relative = F.try_subtract(now, F.try_multiply(F.regexp_extract(text, ago, 1).try_cast("long"), step))
        return (
            F.when(F.lower(text) == "now", now)
            .when(text.startswith("@"), absolute)
            .when(text.rlike(ago), relative)
            .when(text.rlike(CALENDAR), _bound(F.split(F.regexp_replace(text, CALENDAR, "$1,$2,$3,$4,$5,$6,$7"), ","), _calendar))
        )

    return _bound(F.regexp_replace(as_col(col), r"(?U)^\s+|\s+$", ""), read)


def _bound(value: Column, work: Callable[[Column], Column]) -> Column:
    """`work(value)`, with the value worked out once, however often the work uses it."""
    return F.get(F.transform(F.array(value), work), F.lit(0))


# Date, then perhaps a clock with seconds, a fraction (in which only a last sign begins an offset) and a zone.
CALENDAR = (
    r"(?s)^([0-9]+)-([0-9]+)-([0-9]+)"
    r"(?:[Tt ]([0-9]+):([0-9]+)(?::([0-9]+)(?:\.(?:[^:+-]|[+-](?=[^:]*[+-]))*?)?)?([Zz]|[+-][0-9:]*)?)?$"
)


def _calendar(fields: Column) -> Column:
    """Unix seconds of the seven fields of a calendar time."""

    def clock(n: int) -> Column:
        value = F.get(fields, F.lit(n))
        return F.when(value == "", F.lit(0)).otherwise(value.try_cast("int"))

    year, month, day = (F.get(fields, F.lit(n)).try_cast("int") for n in range(3))
    civil = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    in_range = year.between(1970, 9999) & month.between(1, 12) & day.between(1, 31)
    days = F.unix_date(F.when(in_range, civil).try_cast("date")).cast("long")

    hour, minute, second = (clock(n) for n in (3, 4, 5))
    of_day = F.when((hour <= 23) & (minute <= 59) & (second <= 60), hour * 3600 + minute * 60 + second)

    def offset(zone: Column) -> Column:
        digits = F.rpad(F.substring(zone, 2, 4), 4, "0")
        off_h, off_m = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
        ahead = F.when((off_h <= 23) & (off_m <= 59), off_h * 3600 + off_m * 60)
        return F.when(zone.isin("", "Z", "z"), F.lit(0)).when(
            zone.rlike(r"^[+-](?:[0-9]{2}|[0-9]{4})$"), F.when(zone.startswith("-"), -ahead).otherwise(ahead)
        )

    return days * 86400 + of_day - _bound(F.replace(F.get(fields, F.lit(6)), F.lit(":"), F.lit("")), offset)


def is_hex_digest(col: Column | str, algo: str = "sha256") -> Column:
    """Exactly as many hex digits as the algorithm gives."""
    return as_col(col).rlike(rf"\A[0-9a-fA-F]{{{HEX_LENGTH[algo]}}}\z")
