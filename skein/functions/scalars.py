"""Scalar functions on columns: canonical ids, the confidence rubric, tokens and formats."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CONFIDENCE_NAMES, SCORES, TRUST

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = regex.compile(r"[^\p{Alphabetic}\p{N}]+")


def slug(text: Column) -> Column:
    """ASCII letters and digits in lower case; every other run is one underscore, none at the ends.

    The pattern runs before lower(), so letters that only fold into ASCII do not count.
    """
    return F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", "_")), F.lit("_"))


def canonical(namespace: Column, entity: Column) -> Column:
    return F.concat(slug(namespace), F.lit("::"), slug(entity))


def canonical_key(namespace: Column, key: Column) -> Column:
    """`canonical` of a whole number: its slug is its digits, without a pattern run over each."""
    return F.concat(slug(namespace), F.lit("::"), F.ltrim(key.cast("string"), F.lit("-")))


def _by_tag(tag: Column, values) -> Column:
    out = F.when(tag == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], 1):
        out = out.when(tag == i, F.lit(v))
    return out


def score(tag: Column) -> Column:
    """Confidence tag to score; null outside 0..6."""
    return _by_tag(tag, SCORES)


def trust(tag: Column) -> Column:
    return _by_tag(tag, TRUST)


def confidence_name(tag: Column) -> Column:
    return _by_tag(tag, CONFIDENCE_NAMES)


def valid_tag(tag: Column) -> Column:
    return F.coalesce(tag.between(0, 6), F.lit(False))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _ASCII_UPPER, _ASCII_UPPER.lower())


def tokens(text: Column) -> Column:
    """Alphanumeric runs of more than one byte, ASCII lower-cased, repeats kept."""
    return F.filter(F.split(ascii_lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: F.octet_length(t) > 1)


def tokens_of(text: str) -> list[str]:
    """`tokens` of a driver-side string."""
    lowered = text.translate({ord(c): c.lower() for c in _ASCII_UPPER})
    return [t for t in _BREAK.split(lowered) if len(t.encode()) > 1]


def score_text(tag: Column) -> Column:
    return F.format_string("%.2f", score(tag))


def hex_of(value: Column) -> Column:
    return F.lower(F.hex(value))


def le32(n: Column) -> Column:
    """Four little-endian bytes of a non-negative number below 2**32."""
    wide = n.cast("long")
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(wide, s).bitwiseAND(F.lit(255))), 2, "0")) for s in (0, 8, 16, 24)])


def le64(n: Column) -> Column:
    wide = n.cast("long")
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftrightunsigned(wide, s).bitwiseAND(F.lit(255))), 2, "0")) for s in range(0, 64, 8)])


def field(value: Column) -> Column:
    """A length-prefixed field: four bytes of length, then the bytes."""
    raw = value.cast("binary")
    return F.concat(le32(F.octet_length(raw)), raw)


def byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))


def signed_payload(subject: Column, agent: Column, basis: Column, parent_hash: Column, algorithm: Column) -> Column:
    """The bytes that attestations sign: five length-prefixed fields."""
    return F.concat(field(subject), field(agent), field(byte(basis)), field(parent_hash), field(algorithm))
