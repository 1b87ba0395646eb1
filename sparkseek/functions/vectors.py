"""Vector scores and quantization as column expressions; 32-bit sums are folded in element order."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek.config import Metric, Quantization


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def _zero() -> Column:
    return F.lit(0).cast("float")


def total(values: Column) -> Column:
    return F.aggregate(values, _zero(), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sum_of_squares(v: Column) -> Column:
    return total(F.transform(v, lambda x: x * x))


def root(x: Column) -> Column:
    return F.sqrt(x).cast("float")


def inverse(x: Column) -> Column:
    return (F.lit(1.0) / x).cast("float")


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return let(sum_of_squares(v), lambda ss: F.when(ss > 0, let(inverse(root(ss)), lambda i: F.transform(v, lambda x: x * i))).otherwise(v))


def prepared(v: Column, metric: Metric) -> Column:
    return normalized(v) if metric is Metric.COSINE else v


def distance(a: Column, b: Column) -> Column:
    return root(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def _closeness(product: Column) -> Column:
    one = F.lit(1).cast("float")
    return one - (one - product)


def score(q: Column, v: Column, metric: Metric) -> Column:
    """Of prepared vectors."""
    if metric is Metric.EUCLIDEAN:
        return -distance(q, v)
    return _closeness(dot(q, v)) if metric is Metric.COSINE else dot(q, v)


def exact_score(q: Column, v: Column, metric: Metric) -> Column:
    """Of vectors as they are; cosine is 0 where either is a zero vector."""
    if metric is not Metric.COSINE:
        return score(q, v, metric)
    norm = (root(sum_of_squares(q)) * root(sum_of_squares(v))).cast("float")
    return let(norm, lambda n: F.when(n == 0, _zero()).otherwise((dot(q, v) / n).cast("float")))


def int8_scale(v: Column) -> Column:
    most = F.array_max(F.transform(v, F.abs))
    return F.when(most > 0, (most / F.lit(127.0)).cast("float")).otherwise(F.lit(1).cast("float"))


def int8_codes(v: Column) -> Column:
    """Half a step rounds up, towards positive infinity."""
    return let(inverse(int8_scale(v)), lambda i: F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.floor((x * i).cast("double") + 0.5).cast("double"))).cast("tinyint")))


def int8_score(q: Column, codes: Column, scale: Column, metric: Metric) -> Column:
    """A full-precision query against codes."""
    if metric is Metric.EUCLIDEAN:
        return -root(total(F.zip_with(q, codes, lambda x, c: (x - c.cast("float") * scale) * (x - c.cast("float") * scale))))
    product = dot(q, F.transform(codes, lambda c: c.cast("float"))) * scale
    return _closeness(product) if metric is Metric.COSINE else product


def int8_code_score(a: Column, sa: Column, b: Column, sb: Column, metric: Metric) -> Column:
    """Codes against codes."""
    if metric is Metric.EUCLIDEAN:
        return -root(total(F.zip_with(a, b, lambda x, y: (x.cast("float") * sa - y.cast("float") * sb) * (x.cast("float") * sa - y.cast("float") * sb))))
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x).cast("float") * sa * sb
    return _closeness(product) if metric is Metric.COSINE else product


def bits(v: Column, dimensions: int) -> Column:
    """Signs in 64-bit words, the first component in the lowest bit; 0 counts as positive."""
    words = []
    for w in range(0, dimensions, 64):
        word = F.lit(0).cast("bigint")
        for i in range(w, min(w + 64, dimensions)):
            word = word.bitwiseOR(F.when(v[i] >= 0, F.lit(1 << (i - w) if i - w < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        words.append(word)
    return F.array(*words)


def signs(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x >= 0, F.lit(1)).otherwise(F.lit(-1)).cast("float"))


def binary_score(q: Column, sign: Column, dimensions: int, metric: Metric) -> Column:
    """A full-precision query against signs (1 or -1)."""
    if metric is Metric.EUCLIDEAN:
        return -distance(q, sign)
    product = dot(q, sign)
    return _closeness(product * F.lit(1.0 / math.sqrt(dimensions)).cast("float")) if metric is Metric.COSINE else product


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def binary_code_score(a: Column, b: Column, dimensions: int, metric: Metric) -> Column:
    h = hamming(a, b)
    if metric is Metric.EUCLIDEAN:
        return -root((h * 4).cast("float"))
    return (F.lit(1.0) - F.lit(2.0) * h / dimensions).cast("float") if metric is Metric.COSINE else (F.lit(dimensions) - 2 * h).cast("float")


def vector_bytes(dimensions: int, quantization: Quantization) -> int:
    return {Quantization.NONE: 4 * dimensions, Quantization.INT8: dimensions + 4, Quantization.BINARY: 8 * -(-dimensions // 64)}[quantization]
