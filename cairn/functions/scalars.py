"""Scalar expressions: identifiers, times, formats and robust weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Knuth's multiplicative constant and the range of a colour channel.
COLOUR_MULTIPLIER, COLOUR_SPAN, COLOUR_LEAST = 2654435761, 192, 64
#: Lengths up to EXACT_BINS have a bin each, then bins double, TRACK_BINS in all.
EXACT_BINS, TRACK_BINS = 16, 24


def slug(text: Column) -> Column:
    """Letters, digits, _ and -; other runs become -; at most 48 characters; no - at the ends."""
    return F.substring(F.btrim(F.regexp_replace(text, "[^a-zA-Z0-9_-]+", "-"), F.lit("-")), 1, 48)


def colour(identifier: Column) -> Column:
    """A stable (r, g, b) of an id."""
    mixed = (identifier.cast("decimal(38,0)") * F.lit(COLOUR_MULTIPLIER)) % F.lit(1 << 32)
    mixed = mixed.cast("long")
    return F.struct(*((F.pmod(F.shiftright(mixed, s), F.lit(COLOUR_SPAN)) + COLOUR_LEAST).cast("int").alias(n) for n, s in (("r", 0), ("g", 8), ("b", 16))))


def whole_nanoseconds(text: Column) -> Column:
    """Seconds as decimal text to nanoseconds; null unless they are a whole number from 0 below 2^63, however many digits the text has."""
    exponent = F.coalesce(F.nullif(F.regexp_extract(text, "[eE]([+-]?\\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))
    mantissa = F.regexp_replace(text, "[eE].*$", "")
    digits = F.regexp_replace(mantissa, "[^0-9]", "")
    # decimals that are left once the zeros at the end of all digits are taken away
    decimals = F.length(F.regexp_extract(mantissa, "\\.(\\d*)", 1)) - exponent - F.length(digits) + F.length(F.rtrim(digits, F.lit("0")))
    whole = (decimals <= 9) | (F.rtrim(digits, F.lit("0")) == "")
    exact = text.try_cast("decimal(38,9)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.when(whole & (exact >= 0) & (exact < F.lit(str(1 << 63)).cast("decimal(38,0)")), exact.cast("long"))


def track_length_bin(n: Column) -> Column:
    """0-based histogram bin of a track length."""
    wide = EXACT_BINS + F.ceil(F.log2(n / (2.0 * EXACT_BINS)))
    return F.when(n <= EXACT_BINS, n - 1).when(n <= 2 * EXACT_BINS, EXACT_BINS).otherwise(F.least(F.lit(TRACK_BINS - 1), wide)).cast("long")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the JSON object of the columns, keys in order; nulls are written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def encode_cursor(resource: str, *position: str) -> Column:
    """An opaque page position: base64 of JSON, bound to a resource."""
    return F.base64(F.to_json(F.struct(F.lit(resource).alias("resource"), *position)).cast("binary"))


def decode_cursor(cursor: Column, resource: str, schema: str) -> Column:
    """The position's struct; null if the cursor is for another resource."""
    found = F.from_json(F.unbase64(cursor).cast("string"), f"resource string, {schema}")
    return F.when(found["resource"] == resource, found)


def huber_weight(error: Column, delta: float) -> Column:
    size = F.abs(error)
    return F.when(size <= delta, 1.0).otherwise(delta / size)


def huber_cost(squared: Column, delta: float) -> Column:
    return F.when(squared <= delta * delta, squared).otherwise(2 * delta * F.sqrt(squared) - delta * delta)


def soft_l1_cost(squared: Column, delta: float) -> Column:
    """Near the square for errors below delta and near twice their size beyond, without a corner."""
    return 2 * delta * delta * (F.sqrt(1 + squared / (delta * delta)) - 1)


def soft_l1_weight(squared: Column, delta: float) -> Column:
    """The slope of soft_l1_cost: what a squared error counts in a reweighted sum."""
    return 1 / F.sqrt(1 + squared / (delta * delta))


def confidence(sigma: Column, tolerance: float) -> Column:
    """The chance that a Rayleigh error of scale sigma is within the tolerance."""
    return 1 - F.exp(-F.lit(tolerance * tolerance) / (2 * sigma * sigma))


def heat(n: Column, most: Column) -> Column:
    return F.log1p(n) / F.log1p(most)


def keyframe_score(translation: Column, mean_inverse_depth: Column, usage: Column, weight: float) -> Column:
    """A new keyframe is due at 1 or more."""
    moved, unused = translation * mean_inverse_depth * weight, (1 - usage) * weight
    return moved * moved + unused * unused


def seed_score(support: Column, coverage: Column, angle: Column) -> Column:
    return support * coverage * F.least(angle, F.lit(15.0))
