"""Uniform draws that are pure functions of a key, a purpose, a step and a row: independent of partitioning and retries."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that make a coin, and the number of values they have.
DIGITS, VALUES = 13, float(1 << 52)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(str(x))


def coin(key: str, purpose: str, step, row: Column) -> Column:
    """A uniform double in [0, 1). md5 is a test-grade generator; coin_secret() is the one for production."""
    text = F.concat_ws("|", F.lit(key), F.lit(purpose), _column(step).cast("string"), row.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / VALUES


def coin_secret(key: str, purpose: str, step, row: Column) -> Column:
    """The same by SHA-256 of a secret key's text."""
    text = F.concat_ws("|", F.lit(key), F.lit(purpose), _column(step).cast("string"), row.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, DIGITS), 16, 10).cast("double") / VALUES


def gaussian(key: str, purpose: str, step, row: Column) -> Column:
    """A standard normal by Box and Muller's transform of two coins."""
    u, v = coin(key, f"{purpose}-u", step, row), coin(key, f"{purpose}-v", step, row)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)


def drawn_gaussian(key: str, purpose: str, step, row) -> float:
    """gaussian() for one row, on the driver."""
    u, v = (int(hashlib.md5(f"{key}|{purpose}-{x}|{step}|{row}".encode(), usedforsecurity=False).hexdigest()[:DIGITS], 16) / VALUES for x in "uv")
    return math.sqrt(-2.0 * math.log(1.0 - u)) * math.cos(2.0 * math.pi * v)


def laplace(key: str, purpose: str, step, row: Column) -> Column:
    """A Laplace draw of scale 1 by the inverse distribution of one coin."""
    u = coin(key, purpose, step, row) - 0.5
    return -F.signum(u) * F.log(1.0 - 2.0 * F.abs(u))


def sql_coin(key: str, purpose: str, step: str, row: str) -> str:
    """coin() as DuckDB SQL; step and row are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', '{key}', '{purpose}', {step}, {row})), 1, 13))::bigint / 4503599627370496.0::double)"


def sql_gaussian(key: str, purpose: str, step: str, row: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {sql_coin(key, purpose + '-u', step, row)})) * cos(2.0 * pi() * {sql_coin(key, purpose + '-v', step, row)}))"


def sql_laplace(key: str, purpose: str, step: str, row: str) -> str:
    u = f"({sql_coin(key, purpose, step, row)} - 0.5)"
    return f"(-sign({u}) * ln(1.0 - 2.0 * abs({u})))"
