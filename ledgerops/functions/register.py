"""Make the helpers callable from SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ledgerops.functions.scalars import QUANTITY_SUFFIX
from ledgerops.functions.times import UNIT_SECONDS


@pandas_udf(StringType())
def uint256_text(hex_digits: pd.Series) -> pd.Series:
    """Decimal text of a hex quantity of any width: the one place DECIMAL(38) cannot reach."""
    return hex_digits.map(lambda h: None if h is None else str(int(h, 16)))


def _cases(key: str, table: dict, kind: str) -> str:
    """A CASE over a fixed table; null for unknown keys."""
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN CAST({v!r} AS {kind})" for k, v in table.items()) + " END"


def _size_text() -> str:
    scaled = {unit: f"round(size / {1024.0**i!r}D)" for i, unit in enumerate(["kB", "MB", "GB", "TB", "PB"], start=1)}
    text = {unit: f"concat(CAST({n} AS DECIMAL(38,0)), ' {unit}')" for unit, n in scaled.items()}
    steps = " ".join(f"WHEN abs({n}) < 10240 THEN {text[unit]}" for unit, n in list(scaled.items())[:-1])
    return f"CASE WHEN abs(size) < 10240 THEN concat(size, ' bytes') {steps} ELSE {text['PB']} END"


# name -> (parameters, result type, body); SQL functions inline into the caller's plan.
SQL_FUNCTIONS = {
    "age_seconds": (
        "t TIMESTAMP_NTZ, as_of TIMESTAMP_NTZ", "DOUBLE",
        "coalesce(timestampdiff(MICROSECOND, t, as_of) / 1e6D, 0D)",
    ),
    "safe_ratio": (
        "a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN b > 0 THEN coalesce(a, 0D) / b ELSE 0D END",
    ),
    "on_flag": ("t STRING", "INT", "CASE WHEN t = 'on' THEN 1 ELSE 0 END"),
    "lsn_bytes": (
        "p STRING", "DECIMAL(20,0)",
        "CAST(CAST(conv(split_part(p, '/', 1), 16, 10) AS DECIMAL(20,0)) * 4294967296"
        " + CAST(conv(split_part(p, '/', 2), 16, 10) AS DECIMAL(20,0)) AS DECIMAL(20,0))",
    ),
    "normal_address": (
        "a STRING", "STRING",
        "CASE WHEN lower(trim(a)) RLIKE '^0x[0-9a-f]{40}$' THEN lower(trim(a)) END",
    ),
    "qualified_name": ("s STRING, t STRING", "STRING", "concat(s, '.', t)"),
    "md5_hash": ("v STRING", "STRING", "md5(v)"),
    "size_pretty": ("size DECIMAL(38,0)", "STRING", _size_text()),
    "duration_seconds": (
        "v STRING", "BIGINT",
        r"CASE WHEN lower(trim(v)) RLIKE r'^([0-9]+\s*[a-z]+\s*)+$' THEN aggregate("
        r"regexp_extract_all(lower(trim(v)), r'([0-9]+\s*[a-z]+)', 1), 0L, (total, p) -> total + "
        r"CAST(regexp_extract(p, '^([0-9]+)', 1) AS BIGINT) * "
        + _cases("regexp_extract(p, '([a-z]+)$', 1)", UNIT_SECONDS, "BIGINT") + ") END",
    ),
    "parse_quantity": (
        "v STRING", "DOUBLE",
        r"try_cast(regexp_extract(trim(v), r'^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]{0,2})$', 1) AS DOUBLE) * "
        + _cases(r"regexp_extract(trim(v), r'^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]{0,2})$', 2)", QUANTITY_SUFFIX, "DOUBLE"),
    ),
    "parse_iso": ("v STRING", "TIMESTAMP_NTZ", "try_cast(regexp_replace(v, '[zZ]$', '') AS TIMESTAMP_NTZ)"),
    "json_field": ("v STRING, path STRING", "STRING", "get_json_object(v, path)"),
}

# Texts and numbers whose steps are functions of their own: each argument is computed once. Order matters, as later ones call earlier ones.
_UNITS = ["", "k", "M", "G", "T", "P", "E", "Z", "Y"]
_PARTS = ["m", "u", "n", "p", "f", "a", "z"]


def _scaled_text(steps: list[tuple[float, float, str]], least: tuple[float, str]) -> str:
    """Significant digits of v, scaled by the first step whose bound its size reaches."""
    # dividing by a whole power keeps large values exact; small ones are multiplied
    number = lambda f: f"v * {f!r}D" if f >= 1 else f"v / {round(1 / f)!r}e0D"
    whens = " ".join(f"WHEN abs(v) >= {b!r}D THEN concat(significant({number(f)}), '{s}')" for b, f, s in steps)
    return f"CASE {whens} ELSE concat(significant({number(least[0])}), '{least[1]}') END"


_METRIC_STEPS = [(1000.0**i, 1000.0**-i, u) for i, u in reversed(list(enumerate(_UNITS)))] + [(1000.0**-i, 1000.0**i, u) for i, u in enumerate(_PARTS, start=1)]
_WHOLE = "floor(abs(v))"
_CLOCK = ", ".join(
    f"CASE WHEN {_WHOLE} >= {width} THEN concat(CAST(floor({_WHOLE} / {width}) {wrap} AS BIGINT), '{unit}') END"
    for unit, width, wrap in [("d", 86400, ""), ("h", 3600, "% 24"), ("m", 60, "% 60"), ("s", 1, "% 60")]
)
_DIGITS = "lower(regexp_replace(h, '^0[xX]', ''))"

SQL_FUNCTIONS |= {
    "decimal_digits": ("n DOUBLE, places DOUBLE", "STRING", r"regexp_replace(CAST(CAST(n / pow(10D, places) AS DECIMAL(20,7)) AS STRING), r'\.?0+$', '')"),
    # the product p of size and f, with the error of its rounding from the halves of size
    "nearest_of": (
        "size DOUBLE, f DOUBLE, high DOUBLE, p DOUBLE", "DOUBLE",
        "CASE WHEN p - floor(p) = 0.5D AND (high * f - p) + (size - high) * f > 0 THEN floor(p) + 1D"
        " WHEN p - floor(p) = 0.5D AND (high * f - p) + (size - high) * f < 0 THEN CAST(floor(p) AS DOUBLE) ELSE rint(p) END",
    ),
    "nearest_scaled": ("size DOUBLE, f DOUBLE", "DOUBLE", "nearest_of(size, f, size * 134217729D - (size * 134217729D - size), size * f)"),
    "exponent_from": ("size DOUBLE, e DOUBLE", "DOUBLE", "CASE WHEN pow(10D, e + 1) <= size THEN e + 1 WHEN pow(10D, e) > size THEN e - 1 ELSE e END"),
    "scientific_text": (
        "n DOUBLE, e DOUBLE", "STRING",
        "concat(decimal_digits(CASE WHEN n >= 10000 THEN n / 10 ELSE n END, 3D), format_string('e%+03d', CAST(CASE WHEN n >= 10000 THEN e + 1 ELSE e END AS INT)))",
    ),
    "scientific_units": ("size DOUBLE, unit DOUBLE", "DOUBLE", "CASE WHEN size % unit = unit / 2 THEN floor(size / unit) + floor(size / unit) % 2 ELSE rint(size / unit) END"),
    "significant_of": (
        "size DOUBLE, e DOUBLE", "STRING",
        "CASE WHEN e >= -4 AND e < 4 THEN decimal_digits(nearest_scaled(size, pow(10D, 3 - e)), 3 - e) ELSE scientific_text(scientific_units(size, pow(10D, e - 3)), e) END",
    ),
    "significant": (
        "v DOUBLE", "STRING",
        "CASE WHEN v = 0 THEN '0' ELSE concat(CASE WHEN v < 0 THEN '-' ELSE '' END, significant_of(abs(v), exponent_from(abs(v), CAST(floor(log10(abs(v))) AS DOUBLE)))) END",
    ),
    "humanize": ("v DOUBLE", "STRING", f"CASE WHEN v = 0 THEN '0' ELSE {_scaled_text(_METRIC_STEPS, (1e24, 'y'))} END"),
    "humanize_percentage": ("v DOUBLE", "STRING", "concat(significant(v * 100D), '%')"),
    "humanize_duration": (
        "v DOUBLE", "STRING",
        f"CASE WHEN v = 0 THEN '0s' WHEN {_WHOLE} >= 60 THEN concat(CASE WHEN v < 0 THEN '-' ELSE '' END, concat_ws(' ', {_CLOCK}))"
        f" ELSE {_scaled_text([(1.0, 1.0, 's'), (1e-3, 1e3, 'ms'), (1e-6, 1e6, 'us')], (1e9, 'ns'))} END",
    ),
    "hex_digits": (
        "h STRING", "STRING",
        f"CASE WHEN {_DIGITS} RLIKE '^[0-9a-f]+$' THEN coalesce(nullif(ltrim('0', {_DIGITS}), ''), '0') END",
    ),
    "decimal_of_digits": (
        "d STRING", "DECIMAL(38,0)",
        "CASE WHEN length(d) <= 15 THEN CAST(CAST(conv(d, 16, 10) AS BIGINT) AS DECIMAL(38,0)) WHEN length(d) <= 32 THEN CAST(try_add(try_add("
        f"try_multiply(CAST(conv(substring(lpad(d, 45, '0'), 1, 15), 16, 10) AS DECIMAL(38,0)), CAST('{2**120}' AS DECIMAL(38,0))), "
        f"try_multiply(CAST(conv(substring(lpad(d, 45, '0'), 16, 15), 16, 10) AS DECIMAL(38,0)), CAST('{2**60}' AS DECIMAL(38,0)))), "
        "CAST(conv(substring(lpad(d, 45, '0'), 31, 15), 16, 10) AS DECIMAL(38,0))) AS DECIMAL(38,0)) END",
    ),
    "hex_to_decimal": ("h STRING", "DECIMAL(38,0)", "decimal_of_digits(hex_digits(h))"),
    "hex_to_long": ("h STRING", "BIGINT", "try_cast(hex_to_decimal(h) AS BIGINT)"),
    "coin_text": (
        "digits STRING, sign STRING", "DECIMAL(38,18)",
        "CAST(concat(sign, substring(digits, 1, length(digits) - 18), '.', right(digits, 18)) AS DECIMAL(38,18))",
    ),
    "to_coin": (
        "units DECIMAL(38,0)", "DECIMAL(38,18)",
        "coin_text(lpad(CAST(abs(units) AS STRING), greatest(length(CAST(abs(units) AS STRING)), 19), '0'), CASE WHEN units < 0 THEN '-' ELSE '' END)",
    ),
}

_LSN = SQL_FUNCTIONS["lsn_bytes"][2]
SQL_FUNCTIONS["lsn_diff"] = (
    "a STRING, b STRING", "DECIMAL(20,0)",
    f"CAST({_LSN.replace('split_part(p,', 'split_part(a,')} - {_LSN.replace('split_part(p,', 'split_part(b,')} AS DECIMAL(20,0))",
)


def register_functions(spark: SparkSession) -> list[str]:
    """Register the helpers that have a SQL form for this session and return the names."""
    for name, (params, result, body) in SQL_FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}"
        )
    spark.udf.register("uint256_text", uint256_text)
    return [*SQL_FUNCTIONS, "uint256_text"]
