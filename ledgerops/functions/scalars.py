"""Scalar helpers returning Columns; all stay inside generated JVM code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerops.functions.times import UNIT_SECONDS

__all__ = [
    "duration_seconds", "safe_ratio", "flag", "qualified", "md5_hash", "md5_bytes",
    "size_pretty", "humanize", "humanize_percentage", "humanize_duration", "significant",
    "number_text", "render", "value_formats", "hex_to_number", "hex_to_decimal", "word_to_decimal", "lsn_bytes", "lsn_diff",
    "normalize_address", "to_coin", "parse_quantity", "parse_iso", "json_field",
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(key: Column, table: dict) -> Column:
    """A when-ladder over a fixed table; null for unknown keys."""
    by_value: dict = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    branches = [(key.isin(*ks), F.lit(v)) for v, ks in by_value.items()]
    first, *rest = branches
    return reduce(lambda acc, b: acc.when(*b), rest, F.when(*first))


def duration_seconds(col: Column | str) -> Column:
    """Whole seconds of texts like ``90 days``, ``30d``, ``300s``, ``1 day 12 hours``."""
    text = F.lower(F.trim(_col(col)))
    pairs = F.regexp_extract_all(text, F.lit(r"([0-9]+\s*[a-z]+)"), F.lit(1))
    def seconds(pair):
        amount = F.regexp_extract(pair, r"^([0-9]+)", 1).cast("bigint")
        unit = F.regexp_extract(pair, r"([a-z]+)$", 1)
        return amount * _lookup(unit, UNIT_SECONDS).cast("bigint")
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, p: acc + seconds(p))
    return F.when(text.rlike(r"^([0-9]+\s*[a-z]+\s*)+$"), total)


def safe_ratio(a: Column | str, b: Column | str, default: float | None = 0.0) -> Column:
    """a / b as DOUBLE; ``default`` where the denominator is not positive or missing."""
    b = _col(b).cast("double")
    return F.when(b > 0, F.coalesce(_col(a).cast("double"), F.lit(0.0)) / b).otherwise(
        F.lit(default).cast("double")
    )


def flag(col: Column | str, on: str | None = None) -> Column:
    """1 for true (or for the text ``on``), else 0."""
    cond = _col(col) if on is None else _col(col) == on
    return F.when(cond, 1).otherwise(0)


def qualified(schema: Column | str, table: Column | str) -> Column:
    return F.concat(_col(schema), F.lit("."), _col(table))


def md5_hash(col: Column | str) -> Column:
    return F.md5(_col(col).cast("string"))


def md5_bytes(col: Column | str) -> Column:
    return F.unhex(md5_hash(col))


def size_pretty(col: Column | str) -> Column:
    """Bytes as text in the largest unit that keeps the number below 10240; up to 38 digits."""
    size = _col(col).cast("decimal(38,0)")
    units = ["kB", "MB", "GB", "TB", "PB"]
    out = F.when(F.abs(size) < 10240, F.concat(size.cast("string"), F.lit(" bytes")))
    for i, unit in enumerate(units, start=1):
        scaled = F.round(size / F.lit(float(1024**i)))
        text = F.concat(scaled.cast("decimal(38,0)").cast("string"), F.lit(f" {unit}"))
        out = out.otherwise(text) if unit == units[-1] else out.when(F.abs(scaled) < 10240, text)
    return out


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _decimal_text(n: Column, places: Column) -> Column:
    """Text of the whole number n divided by 10^places, trailing zeros dropped."""
    text = (n / F.pow(F.lit(10.0), places)).cast("decimal(20,7)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def _nearest_scaled(size: Column, factor: Column) -> Column:
    """size * factor to the nearest whole number, ties to even, as if computed exactly.

    The product is formed with its rounding error (split of the first factor into two
    halves), so 1.145 counts as the binary number it is and not as a tie.
    """
    def with_halves(high):
        low = size - high
        def with_product(p):
            error = (high * factor - p) + low * factor
            tie = p - F.floor(p) == 0.5
            return F.when(tie & (error > 0), F.floor(p) + 1).when(tie & (error < 0), F.floor(p)).otherwise(F.rint(p))
        return _let(size * factor, with_product)
    return _let(size * F.lit(134217729.0), lambda c: with_halves(c - (c - size)))


def significant(value: Column, digits: int = 4) -> Column:
    """Text with ``digits`` significant digits, no trailing zeros, exponent form outside
    1e-4 .. 10^digits."""
    ten = lambda e: F.pow(F.lit(10.0), e)

    def exponent(size):
        e = F.floor(F.log10(size))
        return _let(e, lambda e: F.when(ten(e + 1) <= size, e + 1).when(ten(e) > size, e - 1).otherwise(e))

    def plain(size, e):
        places = F.lit(digits - 1) - e
        return _decimal_text(_nearest_scaled(size, ten(places)), places)

    def scientific(size, e):
        unit = ten(e - (digits - 1))
        n = F.when(size % unit == unit / 2, F.floor(size / unit) + F.floor(size / unit) % 2).otherwise(F.rint(size / unit))
        def text(n):
            over = n >= 10**digits
            mantissa = F.when(over, n / 10).otherwise(n)
            return F.concat(
                _decimal_text(mantissa, F.lit(digits - 1)),
                F.format_string("e%+03d", F.when(over, e + 1).otherwise(e).cast("int")),
            )
        return _let(n, text)

    def whole(v):
        size = F.abs(v)
        body = _let(
            exponent(size),
            lambda e: F.when((e >= -4) & (e < digits), plain(size, e)).otherwise(scientific(size, e)),
        )
        return F.when(v == 0, F.lit("0")).otherwise(F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), body))

    return _let(value.cast("double"), whole)


def _scaled(v: Column, steps: list[tuple[float, float, str]], otherwise: tuple[float, str]) -> Column:
    """Significant digits of v times the factor of the first step whose bound it reaches, with its suffix."""
    size = F.abs(v)
    factor, suffix = F.lit(otherwise[0]), F.lit(otherwise[1])
    for bound, f, s in reversed(steps):
        factor = F.when(size >= bound, F.lit(f)).otherwise(factor)
        suffix = F.when(size >= bound, F.lit(s)).otherwise(suffix)
    # dividing by a whole power keeps large values exact; small ones are multiplied
    number = F.when(factor >= 1, v * factor).otherwise(v / F.rint(1 / factor))
    return F.concat(significant(number), suffix)


def humanize(value: Column | str) -> Column:
    """Number with a metric prefix, four significant digits."""
    steps = [(1000.0**i, 1000.0**-i, p) for i, p in reversed(list(enumerate(["", "k", "M", "G", "T", "P", "E", "Z", "Y"])))]
    steps += [(1000.0**-i, 1000.0**i, p) for i, p in enumerate(["m", "u", "n", "p", "f", "a", "z"], start=1)]
    v = _col(value).cast("double")
    return _let(v, lambda v: F.when(v == 0, F.lit("0")).otherwise(_scaled(v, steps, (1e24, "y"))))


def humanize_percentage(value: Column | str) -> Column:
    return F.concat(significant(_col(value).cast("double") * 100), F.lit("%"))


def humanize_duration(value: Column | str) -> Column:
    """Seconds as ``1d 2h 3m 4s``; below a minute with four significant digits."""
    units = [("s", 1, 60), ("m", 60, 60), ("h", 3600, 24), ("d", 86400, None)]

    def text(v):
        whole = F.floor(F.abs(v)).cast("bigint")
        parts = []
        for unit, width, wrap in reversed(units):
            n = F.floor(whole / width)
            n = n % wrap if wrap else n
            parts.append(F.when(whole >= width, F.concat(n.cast("bigint").cast("string"), F.lit(unit))))
        clock = F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.concat_ws(" ", *parts))
        short = _scaled(v, [(1.0, 1.0, "s"), (1e-3, 1e3, "ms"), (1e-6, 1e6, "us")], (1e9, "ns"))
        return F.when(v == 0, F.lit("0s")).when(whole >= 60, clock).otherwise(short)

    return _let(_col(value).cast("double"), text)


def number_text(value: Column | str) -> Column:
    """Shortest text of a double; whole numbers without a fraction."""
    v = _col(value).cast("double")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, F.when(whole, v).cast("bigint").cast("string")).otherwise(v.cast("string"))


_TEMPLATE = re.compile(r"\{\{\s*\$(value|labels\.\w+)\s*(?:\|\s*(\w+)\s*)?\}\}")


def value_formats(value: Column | str) -> dict[str | None, Column]:
    """The texts a template can show for a value, by format name."""
    return {
        None: number_text(value),
        "humanize": humanize(value),
        "humanizePercentage": humanize_percentage(value),
        "humanizeDuration": humanize_duration(value),
    }


def render(template: str, value: Column | str, labels, formats: dict | None = None) -> Column:
    """Fill ``{{ $value | fn }}`` and ``{{ $labels.x }}`` places of a text.

    ``labels`` is a map column, or a dict of label name to Column. The template is
    split once on the driver; rows see a plain ``concat``. Several templates over one
    value can share its ``value_formats``.
    """
    formats = formats or value_formats(value)

    def label(name):
        found = labels.get(name) if isinstance(labels, dict) else _col(labels)[name]
        return F.lit("") if found is None else F.coalesce(found.cast("string"), F.lit(""))

    parts, at = [], 0
    for m in _TEMPLATE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        what, fn = m.group(1), m.group(2)
        parts.append(formats[fn] if what == "value" else label(what.split(".", 1)[1]))
        at = m.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def _bare_hex(col: Column | str) -> Column:
    """Lower-case hex digits without 0x and leading zeros; null when malformed."""
    text = F.lower(_col(col))

    def digits(body):
        valid = (F.length(body) > 0) & (F.translate(body, "0123456789abcdef", "") == "")
        return F.when(valid, F.coalesce(F.nullif(F.ltrim(body, F.lit("0")), F.lit("")), F.lit("0")))

    return _let(F.when(text.startswith("0x"), F.substr(text, F.lit(3))).otherwise(text), digits)


def hex_to_decimal(col: Column | str) -> Column:
    """Hex quantity as DECIMAL(38,0); null beyond 38 digits."""
    wide = lambda n: F.lit(str(n)).cast("decimal(38,0)")

    def number(digits):
        def part(i):  # 15 digits = 60 bits, always inside a signed long
            return F.conv(F.substring(F.lpad(digits, 45, "0"), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")

        high = F.try_multiply(part(0), wide(2**120))
        mid = F.try_multiply(part(1), wide(2**60))
        return (
            F.when(F.length(digits) <= 15, F.conv(digits, 16, 10).cast("bigint").cast("decimal(38,0)"))
            .when(F.length(digits) <= 32, F.try_add(F.try_add(high, mid), part(2)).cast("decimal(38,0)"))
        )

    return _let(_bare_hex(col), number)


def word_to_decimal(word: Column) -> Column:
    """A 32-byte word, 64 lower-case hex digits, as DECIMAL(38,0); null beyond 38 digits, and where it is no such word.

    The places of the limbs are fixed, so plain substrings do; most numbers fit the lowest limb.
    """
    limb = lambda first, n: F.conv(F.substring(word, first, n), 16, 10).cast("decimal(38,0)")
    zeros = lambda n: F.substring(word, 1, n) == "0" * n
    scale = lambda bits: F.lit(str(2**bits)).cast("decimal(38,0)")
    wide = F.try_add(F.try_add(F.try_multiply(limb(33, 2), scale(120)), F.try_multiply(limb(35, 15), scale(60))), limb(50, 15))
    valid = (F.length(word) == 64) & (F.translate(word, "0123456789abcdef", "") == "")
    return F.when(~valid, F.lit(None)).when(zeros(49), limb(50, 15)).when(zeros(32), wide.cast("decimal(38,0)")).cast("decimal(38,0)")


def hex_to_number(col: Column | str) -> Column:
    """Struct of the quantity as LONG, as DECIMAL(38,0), and the hex digits kept."""
    dec = hex_to_decimal(col)
    fits = dec <= F.lit(str(2**63 - 1)).cast("decimal(38,0)")
    return F.struct(
        F.when(fits, dec).cast("bigint").alias("as_long"),
        dec.alias("as_decimal"),
        _bare_hex(col).alias("hex"),
    )


def lsn_bytes(col: Column | str) -> Column:
    """Log position ``X/Y`` (hex) as a byte offset."""
    part = lambda i: F.conv(F.split_part(_col(col), F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)")
    return (part(1) * F.lit(2**32).cast("decimal(20,0)") + part(2)).cast("decimal(20,0)")


def lsn_diff(a: Column | str, b: Column | str) -> Column:
    return (lsn_bytes(a) - lsn_bytes(b)).cast("decimal(20,0)")


def normalize_address(col: Column | str) -> Column:
    """Lower-case 20-byte address, or null."""
    text = F.lower(F.trim(_col(col)))
    return F.when(text.rlike(r"^0x[0-9a-f]{40}$"), text)


def to_coin(col: Column | str, decimals: int = 18) -> Column:
    """Smallest units to coins, DECIMAL(38,18).

    Decimal division would keep six digits only at this width, so the point is set in
    the digit text, which is exact.
    """
    units = _col(col).cast("decimal(38,0)")
    digits = F.lpad(F.abs(units).cast("string"), F.greatest(F.length(F.abs(units).cast("string")), F.lit(decimals + 1)), F.lit("0"))
    point = F.length(digits) - decimals
    text = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.lit(decimals)))
    return F.when(units < 0, F.concat(F.lit("-"), text)).otherwise(text).cast("decimal(38,18)")


# Multiplier per quantity suffix.
QUANTITY_SUFFIX = {
    "": 1.0, "m": 1e-3,
    "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18,
    "Ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40, "Pi": 2.0**50, "Ei": 2.0**60,
    "B": 1.0, "kB": 2.0**10, "MB": 2.0**20, "GB": 2.0**30, "TB": 2.0**40,
}


def parse_quantity(col: Column | str) -> Column:
    """``2000m``, ``4Gi``, ``8GB``, ``16kB`` as DOUBLE; null when not a quantity."""
    text = F.trim(_col(col))
    pattern = r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]{0,2})$"
    number = F.regexp_extract(text, pattern, 1)
    suffix = F.regexp_extract(text, pattern, 2)
    return F.when(number != "", number.try_cast("double") * _lookup(suffix, QUANTITY_SUFFIX))


def parse_iso(col: Column | str) -> Column:
    """ISO-8601 text (``T`` separator, optional fraction and ``Z``) as TIMESTAMP_NTZ in UTC."""
    text = F.regexp_replace(_col(col), r"[zZ]$", "")
    return text.try_cast("timestamp_ntz")


def json_field(col: Column | str, path: str) -> Column:
    return F.get_json_object(_col(col), path)
