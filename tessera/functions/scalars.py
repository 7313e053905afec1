"""Digests, canonical JSON, quantisation, safe paths, and exact arithmetic published as directed doubles."""

from __future__ import annotations

import json
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _doubles(*names: str) -> T.StructType:
    """Types are given as objects, as a worker that imports this module has no session to parse them."""
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def digest(domain: str, *parts: Column) -> Column:
    """SHA-256 of the parts after a domain, with bytes of 0 between, so that no two lists of parts agree by chance."""
    zero = F.unhex(F.lit("00"))
    chain = [F.lit(domain).cast("binary")]
    for p in parts:
        chain += [zero, F.coalesce(p.cast("string"), F.lit("")).cast("binary")]
    return F.sha2(F.concat(*chain), 256)


def canonical_json_text(value: object, ascii_only: bool = False) -> str:
    """Sorted keys, no spaces, finite numbers, -0.0 as 0.0.

    >>> canonical_json_text({"b": -0.0, "a": [1, None]})
    '{"a":[1,null],"b":0.0}'
    """

    def plain(v: object) -> object:
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("only finite numbers have a canonical form")
            return 0.0 if v == 0 else v
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical spelling of JSON texts; null where a text is none. Numbers keep the spelling of the language that made the digests."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical_json_text(json.loads(t))
        except ValueError:
            return None

    return text.map(one, na_action=None)


def safe_path(path: Column, most_parts: int = 16) -> Column:
    """A relative path with forward slashes and neither empty parts, dots, backslashes nor zero bytes."""
    parts = F.split(path, "/")
    return F.coalesce((F.length(path) > 0) & ~path.contains("\\") & ~path.contains("\0") & (F.size(parts) <= most_parts) & F.forall(parts, lambda p: ~p.isin("", ".", "..")), F.lit(False))


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_identifier(value: Column, most: int = 512) -> Column:
    return F.coalesce((F.length(value).between(1, most)) & ~value.rlike(r"\s"), F.lit(False))


def quantise(value: Column, unit: float = 1e-6) -> Column:
    """The grid key of a coordinate, halves to the even key."""
    return F.bround(value / unit).cast("long")


def hash_integer(namespace: str, label: Column, below: int) -> Column:
    """A number from 0 to below - 1 out of the first eight bytes of a SHA-256."""
    h = F.sha2(F.concat(F.lit(namespace).cast("binary"), F.unhex(F.lit("00")), label.cast("string").cast("binary")), 256)
    return (F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)") % below).cast("long")


def vertical_contact(bottom: Column, surface: Column) -> Column:
    return F.abs(bottom - surface)


def greatest_difference(a: Column, b: Column) -> Column:
    """The largest absolute difference of two arrays of numbers, infinite for arrays of different sizes."""
    return F.when(F.size(a) == F.size(b), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))).otherwise(F.lit(float("inf")))


def below(x: Fraction) -> float:
    """The largest double that is not above x."""
    f = float(x)
    return math.nextafter(f, -math.inf) if Fraction(f) > x else f


def above(x: Fraction) -> float:
    """The least double that is not below x."""
    f = float(x)
    return math.nextafter(f, math.inf) if Fraction(f) < x else f


def sine_cosine_bounds(degrees: float, terms: int = 24) -> tuple[tuple[Fraction, Fraction], tuple[Fraction, Fraction]]:
    """Rational bounds of sine and cosine of an angle that is exactly this double, by alternating series with a rational bound of pi.

    >>> s, c = sine_cosine_bounds(30.0)
    >>> s[0] <= Fraction(1, 2) <= s[1] and s[1] - s[0] < Fraction(1, 10**12)
    True
    """
    # fixed values: the first digits of pi, from below and above
    pi = (Fraction(31415926535897932384626433832795028841, 10**37), Fraction(31415926535897932384626433832795028842, 10**37))
    turn = Fraction(degrees) % 360
    quarter, rest = divmod(turn, 90)
    lo, hi = sorted((rest * pi[0] / 180, rest * pi[1] / 180))

    def series(x: Fraction, start: int) -> tuple[Fraction, Fraction]:
        term = x if start else Fraction(1)
        total, k, last = Fraction(0), start, Fraction(0)
        for _ in range(terms):
            last = total
            total += term
            term = -term * x * x / ((k + 1) * (k + 2))
            k += 2
        return min(last, total), max(last, total)

    sine = (max(Fraction(0), series(lo, 1)[0]), min(Fraction(1), series(hi, 1)[1]))
    cosine = (max(Fraction(0), series(hi, 0)[0]), min(Fraction(1), series(lo, 0)[1]))
    if rest == 0:
        sine, cosine = (Fraction(0), Fraction(0)), (Fraction(1), Fraction(1))
    minus = lambda b: (-b[1], -b[0])
    return [(sine, cosine), (cosine, minus(sine)), (minus(sine), minus(cosine)), (minus(cosine), sine)][int(quarter)]


@F.pandas_udf(_doubles("sin_lo", "sin_hi", "cos_lo", "cos_hi"))
def directed_turn(degrees: pd.Series) -> pd.DataFrame:
    """Doubles that surely enclose sine and cosine of an angle in degrees; null angles give nulls."""
    rows = []
    for d in degrees:
        if d is None or not math.isfinite(d):
            rows.append((None, None, None, None))
            continue
        s, c = sine_cosine_bounds(float(d))
        rows.append((below(s[0]), above(s[1]), below(c[0]), above(c[1])))
    return pd.DataFrame(rows, columns=["sin_lo", "sin_hi", "cos_lo", "cos_hi"])


@F.pandas_udf(_doubles("lo", "hi"))
def directed_sum(values: pd.Series) -> pd.DataFrame:
    """Doubles that surely enclose the exact sum of an array of doubles."""
    rows = []
    for v in values:
        total = sum((Fraction(float(x)) for x in v), Fraction(0)) if v is not None else None
        rows.append((None, None) if total is None else (below(total), above(total)))
    return pd.DataFrame(rows, columns=["lo", "hi"])
