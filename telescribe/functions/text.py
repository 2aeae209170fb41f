"""Column functions over log texts, clocks and arrays; all of them stay in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a template replaces, in this order; only numbers are values.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
HEX = r"\b0x[0-9a-fA-F]+\b"
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
# Templates that are different each time, and so say nothing of a window.
UNSTABLE = (r"^[0-9a-fA-F\s]{20,}$", r"(?i)(GET|POST|PUT|DELETE)\s+/", r"""(?i)^\s*\{.*"(id|uuid|session)":""")


def template(message: Column) -> Column:
    """The message with UUIDs, hexadecimal and other numbers replaced by #."""
    for pattern in (UUID, HEX, NUMBER):
        message = F.regexp_replace(message, pattern, "#")
    return message


def template_values(message: Column) -> Column:
    """The numbers that template() replaces, in order; UUIDs and hexadecimal ones give no value."""
    for pattern in (UUID, HEX):
        message = F.regexp_replace(message, pattern, "#")
    return F.transform(F.regexp_extract_all(message, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def first_match(message: Column, rules, default: str | None = None) -> Column:
    """The label of the first (regex, label) that the message holds, whatever its case."""
    return chosen([(message.rlike(f"(?i){pattern}"), F.lit(label)) for pattern, label in rules], F.lit(default).cast("string"))


def chosen(arms: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """The value of the first condition that holds, as one flat CASE."""
    out = F.when(*arms[0])
    for condition, value in arms[1:]:
        out = out.when(condition, value)
    return out if default is None else out.otherwise(default)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row, however often they are read: the optimiser copies a plain column into
    each filter and column that reads it, but none out of a generator."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def unstable(text: Column) -> Column:
    out = text.rlike(UNSTABLE[0])
    for pattern in UNSTABLE[1:]:
        out = out | text.rlike(pattern)
    return out


def any_match(message: Column, patterns) -> Column:
    return message.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def clock_ms(clock: Column, half: Column) -> Column:
    """Milliseconds since midnight of H:MM:SS.mmm; half is AM, PM or null for 24 hours."""
    part = lambda i: F.regexp_extract(clock, r"(\d{1,2}):(\d{2}):(\d{2})(\.\d+)?", i)
    hour = part(1).cast("int")
    hour = F.when(half == "PM", hour % 12 + 12).when(half == "AM", hour % 12).otherwise(hour)
    second = part(3).cast("double") + F.coalesce(F.concat(F.lit("0"), part(4)).try_cast("double"), F.lit(0.0))
    return F.round(((hour * 60 + part(2).cast("int")) * 60 + second) * 1000, 3)


def local_time(ts_us: Column, hours: int = 8) -> Column:
    """yyyy-MM-dd HH:mm:ss.SSS, milliseconds cut, at a fixed distance from UTC."""
    return F.date_format(F.timestamp_micros(ts_us + hours * 3_600_000_000), "yyyy-MM-dd HH:mm:ss.SSS")
