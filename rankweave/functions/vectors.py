"""Dense vectors in array columns: arithmetic in double, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.text import let

CHUNK_WORDS = 170
CHUNK_OVERLAP = 30


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Zero vectors stay as they are."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null: ``least`` and ``greatest`` alone would skip it and give a bound."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; 0 where a norm is 0."""
    return F.coalesce(clamp(F.try_divide(dot(a, b), norm(a) * norm(b))), F.lit(0.0))


def mean_pool(vectors: DataFrame, key: str, vector: str, out: str = "vector", normalise: bool = True) -> DataFrame:
    """The element-wise mean of each key's vectors; partial sums are combined before the shuffle."""
    pos = vectors.select(F.col(key), F.posexplode(vector).alias("i", "x"))
    means = pos.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    pooled = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.getField("m")).alias(out))
    return pooled.withColumn(out, l2_normalise(F.col(out))) if normalise else pooled


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _windows(words: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, the last one the first that reaches the end."""
    step = max(1, size - overlap)
    n = F.size(words)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))


def chunk_text(text: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Paragraphs packed up to ``size`` words; a longer one cut to overlapping windows. Blank text has no chunks."""
    return let(F.regexp_replace(text, r"^\s+|\s+$", ""), lambda trimmed: _chunks(trimmed, size, overlap))


def _chunks(trimmed: Column, size: int, overlap: int) -> Column:
    paragraphs = F.filter(F.transform(F.split(trimmed, r"\n\s*\n"), _words), lambda w: F.size(w) > 0)
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("buffer"))
    flushed = lambda a: F.when(F.size(a.getField("buffer")) > 0, F.concat(a.getField("out"), F.array(F.array_join(a.getField("buffer"), " ")))).otherwise(a.getField("out"))

    def add(acc: Column, words: Column) -> Column:
        none = F.array().cast("array<string>")
        long = F.struct(F.concat(flushed(acc), _windows(words, size, overlap)).alias("out"), none.alias("buffer"))
        full = F.struct(flushed(acc).alias("out"), words.alias("buffer"))
        fits = F.struct(acc.getField("out").alias("out"), F.concat(acc.getField("buffer"), words).alias("buffer"))
        return F.when(F.size(words) > size, long).when(F.size(acc.getField("buffer")) + F.size(words) > size, full).otherwise(fits)

    # A text that isn't blank has a word, and so a chunk.
    return F.aggregate(paragraphs, empty, add, flushed)


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an encoder: word counts in hashed dimensions, normalised, without Python."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    counted = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))
    return let(let(slots, counted), l2_normalise)


def vector_key(text: Column) -> Column:
    """The cache key of a text's vector."""
    return F.concat(F.lit("k"), F.substring(F.sha2(text.cast("binary"), 256), 1, 32))
