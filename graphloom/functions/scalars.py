"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Requirement types by the first pattern that fits; fixed values, in this order.
REQUIREMENT_TYPES = (
    ("data", r"(?i)\bmigrat"), ("security", r"(?i)\b(secur|auth|permission|access control)"), ("performance", r"(?i)\b(performance|latency|throughput|under \d+\s*(ms|s\b))"),
    ("observability", r"(?i)\b(log|logging|metric|monitor|alert|trace)"), ("testing", r"(?i)\btest(s|ing|ed)?\b"), ("documentation", r"(?i)\b(document|docs|readme)\b"),
    ("integration", r"(?i)\b(event|publish|subscribe|queue|topic|webhook|api)\b"), ("operational", r"(?i)\b(deploy|rollout|backup|restore|on-call)\b"),
)


def normalized(text: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def name_tokens(text: Column) -> Column:
    """Tokens of a name: humps of camel case and runs between punctuation, lower-cased."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " +"), lambda t: t != "")


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")


def stem(token: Column) -> Column:
    """A token without four kinds of endings, stripped one after the other."""
    for ending in ("(ings|ing)$", "(ers|er)$", "(ions|ion)$", "(es|s)$"):
        token = F.regexp_replace(token, ending, "")
    return token


def stems(tokens: Column) -> Column:
    """The distinct stems of three letters or more."""
    return F.array_distinct(F.filter(F.transform(tokens, stem), lambda t: F.length(t) >= 3))


def first_of(text: Column, patterns, default: str | None) -> Column:
    """The name of the first (name, pattern) that fits."""
    out = F.lit(default)
    for name, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def priority(text: Column) -> Column:
    return first_of(text, [(p, rf"(?i)\b{p}\b") for p in ("must", "should", "could")], None)


def flattened(text: Column) -> Column:
    """Trimmed, lower case, with single spaces."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def content_id(prefix: str, text: Column) -> Column:
    """``prefix`` and the 32-bit FNV-1a hash, in hex, of the trimmed lower-case text with single spaces, over UTF-16 units."""
    flat = flattened(text)
    units = F.filter(F.transform(F.split(F.hex(F.encode(flat, "UTF-16BE")), "(?<=\\G.{4})"), lambda h: F.conv(h, 16, 10).cast("long")), lambda u: u.isNotNull())
    mask = F.lit(0xFFFFFFFF)
    mixed = F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda s, u: (s.bitwiseXOR(u) * F.lit(0x01000193)).bitwiseAND(mask))
    return F.concat(F.lit(f"{prefix}-"), F.lower(F.lpad(F.hex(mixed), 8, "0")))


def requirement_type(text: Column) -> Column:
    return first_of(text, REQUIREMENT_TYPES, "functional")


def latency_bucket(seconds: Column) -> Column:
    return F.when(seconds < 3, "<3s").when(seconds < 30, "3-30s").when(seconds < 120, "30s-2m").otherwise(">2m")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
