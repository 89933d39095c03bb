"""Vector and hash functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or one is all zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def usable(v: Column, size: Column | int) -> Column:
    """Finite, as long as the model says, and not all zero."""
    n = size if isinstance(size, Column) else F.lit(size)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == n) & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def file_checksum(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def text_hash(text: Column) -> Column:
    """The first eight bytes of the SHA-256, in hex."""
    return F.substring(F.sha2(text, 256), 1, 16)


def parsed_time(text: Column) -> Column:
    """RFC 3339 and the formats of office files; null where none fits or ''."""
    forms = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    t = F.when(F.trim(text) != "", F.trim(text))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms])
