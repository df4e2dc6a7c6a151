"""Column expressions on ``ARRAY<DOUBLE>`` vectors."""

from pyspark.sql import functions as F


def vector(values):
    """Literal vector.  Its length is one record's width, never a table's."""
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def sq_norm(a):
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)


def l2_norm(a):
    return F.sqrt(sq_norm(a))


def let(value, use):
    """Evaluate ``value`` once and hand the result to ``use``.

    A lambda evaluates outer expressions again for every element; binding them first keeps the
    work proportional to the vector's length.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scaled(a, factor):
    return let(factor, lambda f: F.transform(a, lambda v: v * f))


def clip_scalar(value, bound):
    """Shrink a number to absolute size ``bound``; 0 switches clipping off, -1 means no bound."""
    if bound in (0, -1) or bound == float("inf"):
        return value
    return value / F.greatest(F.lit(1.0), F.abs(value) / F.lit(float(bound)))


def clip_l2(a, bound):
    """Shrink a vector to Euclidean length ``bound``; 0 and -1 as for :func:`clip_scalar`."""
    if bound in (0, -1) or bound == float("inf"):
        return a
    return scaled(a, F.lit(1.0) / F.greatest(F.lit(1.0), l2_norm(a) / F.lit(float(bound))))


def unit(a):
    """Vector divided by its length; a zero vector stays as it is."""
    inverse = F.coalesce(F.try_divide(F.lit(1.0), l2_norm(a)), F.lit(1.0))
    return scaled(a, inverse)


def padded(a, width):
    missing = F.greatest(F.lit(0), F.lit(width) - F.size(a))
    return F.concat(a, F.array_repeat(F.lit(0.0), missing))
