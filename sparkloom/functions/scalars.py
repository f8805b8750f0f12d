"""Scalar functions on columns. All are built-in expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Basic parameter types that say nothing about a signature.
BASIC_TYPES = ["string", "int", "bool", "error", "byte", "any", "float64", "int64"]


def short_name(path: Column) -> Column:
    """The last two segments of a path by ``/``; a shorter path as it is."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(path)


def last_segment(name: Column, mark: str = "/") -> Column:
    return F.substring_index(name, mark, -1)


def package_of(key: Column) -> Column:
    """What stands before the last dot of a function key; empty without a dot."""
    return F.regexp_extract(key, r"^([\s\S]*)\.[^.]*\z", 1)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def noisy_or(scores: Column) -> Column:
    """1 - prod(1 - s) with s cut to 0..1; 0 without scores."""
    return F.lit(1.0) - F.aggregate(scores, F.lit(1.0), lambda a, s: a * (F.lit(1.0) - F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over characters, each share taken of the length in bytes; 0 for the empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    bytes_ = F.octet_length(text).cast("double")

    def one(c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / bytes_
        return -p * F.log2(p)

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.aggregate(F.transform(F.array_distinct(chars), one), F.lit(0.0), lambda a, x: a + x))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct items; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def parameter_types(signature: Column) -> Column:
    """Distinct, sorted types between the first ``(`` and the last ``)``, without basic types."""
    inner = F.regexp_extract(signature, r"^[^(]*\(([\s\S]*)\)[^)]*\z", 1)

    def kind(part: Column) -> Column:
        part = F.trim(part)
        word = F.when(part.contains(":"), F.substring_index(part, ":", -1)).otherwise(F.substring_index(part, " ", -1))
        return F.regexp_replace(F.trim(word), r"^[*\[\].)]+|[*\[\].)]+\z", "")

    kinds = F.filter(F.transform(F.split(inner, ","), kind), lambda t: (t != "") & ~t.isin(*BASIC_TYPES))
    return F.array_sort(F.array_distinct(kinds))


def verb_of(name: Column) -> Column:
    """What stands before the first capital from the second character on; empty without one."""
    return F.regexp_extract(name, r"^(.[^A-Z]*)[A-Z]", 1)


def return_part(signature: Column) -> Column:
    return F.trim(F.substring_index(signature, ")", -1))


def digest_of(items: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of the SHA-256 of the sorted items."""
    return F.substring(F.sha2(F.array_join(F.array_sort(items), ","), 256), 1, digits)


def is_test_file(name: Column) -> Column:
    base = last_segment(name)
    return base.endswith("_test.go") | base.startswith("test_") | base.contains(".test.") | base.contains(".spec.") | base.contains("_test.py")


def is_comment(line: Column) -> Column:
    t = F.ltrim(F.translate(line, "\t\r", "  "))
    return t.startswith("//") | t.startswith("#") | t.startswith("/*") | t.startswith("*")


def matches_filter(path: Column, wanted: list[str]) -> Column:
    """The path equals a filter, or is longer and ends with it."""
    out = F.lit(False)
    for w in wanted:
        out = out | (path == w) | ((F.length(path) > len(w)) & path.endswith(w))
    return out


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero on the binary value scaled up, for x >= 0."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)
