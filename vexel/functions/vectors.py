"""Vector expressions over array columns: all are built-in functions, so they stay in the JVM and Catalyst sees them.

Arithmetic is in DOUBLE whatever the element type. A pair of unlike dimensions is an error (dot() alone may truncate).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dimension(e: Column | str) -> Column:
    return F.size(col(e))


def element(e: Column | str, i: int) -> Column:
    """The i-th element from 0, null beyond the end."""
    return F.get(col(e), F.lit(i))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def checked(a: Column, b: Column, value: Column) -> Column:
    """value, or an error if the dimensions differ."""
    message = F.concat(F.lit("vectors of dimensions "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(F.size(a) != F.size(b), F.raise_error(message).cast("double")).otherwise(value)


def dot(a: Column | str, b: Column | str, truncate: bool = False) -> Column:
    """Inner product; truncate: of the first elements that both have."""
    a, b = col(a), col(b)
    product = total(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))
    return product if truncate else checked(a, b, product)


def magnitude(e: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(e), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(e: Column | str) -> Column:
    """To length 1; a zero vector stays."""
    e = col(e)
    n = magnitude(e)
    return F.when(n == 0, F.transform(e, lambda x: x.cast("double"))).otherwise(F.transform(e, lambda x: x.cast("double") / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either is a zero vector."""
    a, b = col(a), col(b)
    n = magnitude(a) * magnitude(b)
    return checked(a, b, F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b, truncate=True) / n))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine(a, b)


def angular_distance(a: Column | str, b: Column | str) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


def euclidean(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return checked(a, b, F.sqrt(total(squares)))


def inner_product_to_cosine(ip: Column | str, a: Column | str, b: Column | str) -> Column:
    n = magnitude(a) * magnitude(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(col(ip) / n)


def score(distance: Column | str) -> Column:
    return 1 / (1 + col(distance))


#: Distances by name; all are least for the nearest.
METRICS = {"l2": euclidean, "cosine": cosine_distance}


def sq8_encode(e: Column | str) -> Column:
    """Scalar quantization to bytes: a struct of data (0 to 255 each), min and max. A constant vector becomes zeros."""
    e = F.transform(col(e), lambda x: x.cast("double"))
    low, high = F.array_min(e), F.array_max(e)
    data = F.transform(e, lambda x: F.when(high == low, F.lit(0)).otherwise(F.round((x - low) / (high - low) * 255)).cast("smallint"))
    return F.struct(data.alias("data"), low.alias("min"), high.alias("max"))


def sq8_decode(q: Column | str) -> Column:
    q = col(q)
    return F.transform(q["data"], lambda b: q["min"] + b / F.lit(255.0) * (q["max"] - q["min"]))


def pq_split(dimensions: int, subspaces: int) -> list[tuple[int, int]]:
    """First element (from 0) and length of each subspace; the last one takes the remainder."""
    size = dimensions // subspaces
    return [(i * size, size if i < subspaces - 1 else dimensions - i * size) for i in range(subspaces)]


def pq_encode(e: Column | str, codebook: list[list[list[float]]], dimensions: int) -> Column:
    """The index of the nearest centroid in each subspace (the first of equally near ones), at most 256 a subspace. The
    codebook is a plan constant: its size is that of the model."""
    if not codebook:
        return F.array().cast("array<int>")
    e, codes = col(e), []
    for (first, length), centroids in zip(pq_split(dimensions, len(codebook)), codebook):
        part = F.slice(e, first + 1, length)
        options = [F.struct(euclidean(part, F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]
        codes.append(F.array_min(F.array(*options))["i"])
    return F.array(*codes)


def pq_decode(codes: Column | str, codebook: list[list[list[float]]]) -> Column:
    """The centroids of the codes, one after the other; a code without a centroid is skipped."""
    books = [F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids]) for centroids in codebook]
    parts = [F.coalesce(F.get(book, F.get(col(codes), F.lit(i))), F.array().cast("array<double>")) for i, book in enumerate(books)]
    return F.flatten(F.array(*parts)) if parts else F.array().cast("array<double>")


def vector_key(user_id: Column | str) -> Column:
    """A stable 64-digit key of a user's id, and display_id() its short form."""
    return F.sha2(col(user_id).cast("string"), 256)


def display_id(user_id: Column | str) -> Column:
    return F.concat(F.lit("vec_"), F.substring(vector_key(user_id), 1, 8))


def valid_vector(e: Column | str, dimensions: int | None = None) -> Column:
    """Not null or empty, no null, NaN or infinite element, and of the dimension if one is given."""
    e = col(e)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = e.isNotNull() & (F.size(e) > 0) & fine
    return F.coalesce(out if dimensions is None else out & (F.size(e) == dimensions), F.lit(False))
