"""Field names: quoting, percent-encoding, and the same encoding as Column expressions.

Schema names are driver-side strings, so they use plain Python. Names held as
*data* use the Column forms, which stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from urllib.parse import quote, unquote

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# What Python calls whitespace. Java's Unicode class lacks four of these separators.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_SPACE = r"[\s\x1c-\x1f]"


def quoted(name: str) -> str:
    """``name`` as one backtick-quoted identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def named_col(name: str) -> Column:
    """The column called exactly ``name``; dots in it are not struct access."""
    return F.col(quoted(name))


def normalise_name(raw: str) -> str:
    """Stripped and percent-encoded; letters, digits and ``_.-~/`` stay."""
    return quote(raw.strip())


def denormalise_name(raw: str) -> str:
    """Stripped and percent-decoded, the inverse of :func:`normalise_name`."""
    return unquote(raw.strip())


def java_regex(pattern: str) -> str:
    """A Python-style pattern for Spark's regex functions, with Unicode whitespace.

    ``\\s`` is widened where it stands for white space: not behind an escaped backslash; inside a character class its
    characters are written out, so that negated classes stay right. Classes within classes are not supported.
    """
    out, inside, at = [], False, 0
    while at < len(pattern):
        part = pattern[at:at + 2] if pattern[at] == "\\" else pattern[at]
        if part == r"\s":
            out.append(_SPACE[1:-1] if inside else _SPACE)
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
        at += len(part)
    return "(?U)" + "".join(out)


def strip(col: Column | str) -> Column:
    """Unicode-aware trim on both ends."""
    return F.btrim(_as_col(col), F.lit(_SPACES))


def encode_names(col: Column | str) -> Column:
    """:func:`normalise_name` for string values."""
    out = F.url_encode(strip(col))
    # form encoding -> path encoding: the four characters on which they differ
    for form, path in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(form), F.lit(path))
    return out


def decode_names(col: Column | str) -> Column:
    """:func:`denormalise_name` for string values.

    A ``%`` that starts no valid escape is kept as it stands, so a string that
    mixes valid and malformed escapes still decodes.
    """
    literal_percent = F.regexp_replace(strip(col), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(literal_percent, F.lit("+"), F.lit("%2B")))


def require_distinct(spark: SparkSession, names: Iterable[str], what: str) -> None:
    """Raise ``ValueError`` if two names would be one and the same to the session."""
    sensitive = spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    seen = Counter(n if sensitive else n.lower() for n in names)
    clashes = sorted(n for n, count in seen.items() if count > 1)
    if clashes:
        raise ValueError(f"{what} gives colliding names: {clashes}")


def _as_col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
