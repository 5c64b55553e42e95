"""Deterministic identifiers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the OID namespace of RFC 4122
_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The name-based (SHA-1) uuid of a text in the OID namespace; no UDF."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.substring(variant, -1, 1), part(18, 3)), part(21, 12))


def folded(name: Column) -> Column:
    """Lower case, blanks to underscores, apostrophes dropped: the form in which names become ids."""
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def node_id(class_name: str, *identity: Column) -> Column:
    """Id of a record by its class and identity fields."""
    return uuid5(F.concat(F.lit(f"{class_name}:"), F.concat_ws("|", *(folded(c.cast("string")) for c in identity))))


def edge_id(source: Column, relationship: Column, target: Column) -> Column:
    """Id of an edge: its parts are joined without a separator, then folded."""
    return uuid5(folded(F.concat(source, relationship, target)))


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def chunk_id(document: Column, content: Column, occurrence: Column) -> Column:
    """Id of a chunk by its document, the hash of its text and how often that text came before."""
    return uuid5(F.concat_ws(":", document.cast("string"), content, occurrence.cast("string")))


def reference_fingerprint(*fields: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the fields."""
    return F.substring(F.sha1(F.encode(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), "UTF-8")), 1, 16)
