"""Vector functions as Column expressions; all run in the JVM, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

METRICS = ("l2", "inner_product", "cosine")


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    """Sum of squared differences, without a root."""
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def l2_squared_part(a: Column, b: Column, start: int, length: int) -> Column:
    """l2_squared of components start .. start + length - 1."""
    return l2_squared(F.slice(a, start + 1, length), F.slice(b, start + 1, length))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm_squared(a: Column) -> Column:
    return _sum(F.transform(as_double(a), lambda x: x * x))


def normalize(a: Column) -> Column:
    """To unit length; a zero vector stays as it is."""
    n = F.sqrt(norm_squared(a))
    return F.when(n > 0, F.transform(as_double(a), lambda x: x / n)).otherwise(as_double(a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either vector is zero."""
    n = F.sqrt(norm_squared(a) * norm_squared(b))
    return F.when(n > 0, 1 - inner_product(a, b) / n).otherwise(F.lit(1.0))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Ranking distance, lower is nearer: squared L2, negative inner product, or 1 - cosine."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return l2_squared(a, b) if metric == "l2" else -inner_product(a, b) if metric == "inner_product" else cosine_distance(a, b)


def madd(a: Column, factor: float, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + F.lit(float(factor)) * y)


def residual(v: Column, centroid: Column) -> Column:
    return madd(v, -1.0, centroid)


def preprocess(v: Column, metric: str) -> Column:
    return normalize(v) if metric == "cosine" else as_double(v)


def sq_encode(v: Column, mins: Column, maxs: Column) -> Column:
    """8-bit scalar codes: round(clamp((v - min) * 255 / (max - min))), 0 where min >= max."""
    span = F.zip_with(mins, maxs, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))

    def code(x: Column, b: Column) -> Column:
        scaled = F.least(F.greatest((x - b["lo"]) * 255 / (b["hi"] - b["lo"]), F.lit(0.0)), F.lit(255.0))
        return F.when(b["lo"] >= b["hi"], F.lit(0)).otherwise(F.floor(scaled + 0.5).cast("int"))

    return F.zip_with(as_double(v), span, code)


def sq_decode(codes: Column, mins: Column, maxs: Column) -> Column:
    span = F.zip_with(mins, maxs, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    return F.zip_with(codes, span, lambda c, b: F.when(b["lo"] >= b["hi"], b["lo"]).otherwise(b["lo"] + c * (b["hi"] - b["lo"]) / 255))


def adc_distance(table: Column, codes: Column) -> Column:
    """Sum over sub-spaces of table[sub][code]."""
    return _sum(F.zip_with(table, codes, lambda t, c: F.element_at(t, c + 1)))


def check_vector(v: Column, dimension: int) -> Column:
    """The vector; an error if its length differs or a component isn't finite."""
    good = (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, v).otherwise(F.raise_error(F.lit(f"a vector must have {dimension} finite components")))
