"""Vector expressions on arrays, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of the common prefix."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0))), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is empty or zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays. Its length is bound to a name, or it would be summed anew for each component."""
    scaled = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.transform(F.array(norm(a)), scaled)[0]


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine of vectors already at length one (or zero): one pass."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def truth_score(node: Column, query: Column) -> Column:
    """Mean of a node's coordinates weighted by the query's positive ones, within 0..1; 0.5 if there are none."""
    weights = F.transform(query, lambda q: F.greatest(q, F.lit(0.0)))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(node, weights) / total))).otherwise(0.5)


def truth_factor(node: Column, query: Column) -> Column:
    return 0.75 + 0.5 * truth_score(node, query)


def running_centroid(old: Column, count: Column, new: Column) -> Column:
    """Mean after one more vector, at length one."""
    return unit(F.zip_with(old, new, lambda o, n: (o * count + n) / (count + 1)))


def moved(old: Column, new: Column, tolerance: float) -> Column:
    """Whether any component moved by more than the tolerance."""
    return F.exists(F.zip_with(old, new, lambda o, n: F.abs(o - n) > tolerance), lambda x: x)
