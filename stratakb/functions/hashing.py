"""Digests, token estimates, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(c: Column, digits: int = 32) -> Column:
    """The first hex digits of the SHA-256: 32 for contents and evidence, 16 for queries, 8 for identities."""
    return F.substring(F.sha2(c, 256), 1, digits)


def token_estimate(c: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(c) / 4)


def normal_path(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def fqn(path: Column, parents: Column, name: Column) -> Column:
    """Path without extension, dots for slashes, then parents and name."""
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    return F.concat_ws(".", F.translate(stem, "/", "."), F.array_join(F.array_append(parents, name), "."))


def last_segment(c: Column) -> Column:
    return F.regexp_extract(c, r"([^.:]*)$", 1)


def file_stem(c: Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    base = F.regexp_extract(c, r"([^/]*)/*$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def is_minified(c: Column) -> Column:
    return c.rlike(r"\.min\.[^.]*$")


def normal_remote(c: Column) -> Column:
    """host/path of a git remote in any of its spellings, without user, port, .git and trailing slash; lower-case host."""
    s = F.regexp_replace(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    s = F.regexp_replace(s, r"^[^@/]*@", "")
    s = F.regexp_replace(s, r"^([^/:]+):(?:\d+/)?", "$1/")
    s = F.regexp_replace(F.regexp_replace(s, r"/+$", ""), r"\.git$", "")
    return F.concat(F.lower(F.regexp_extract(s, "^([^/]*)", 1)), F.regexp_extract(s, "^[^/]*(.*)$", 1))


def repo_key(identity: Column) -> Column:
    """A readable slug of at most 40 characters and 8 digits of the identity's hash."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(identity), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.substring(slug, -40, 40), F.lit("-"), short_hash(identity, 8))


def version_tuple(c: Column) -> Column:
    """Dotted version as numbers to compare; parts that aren't numbers are 0."""
    return F.transform(F.split(c, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(0)))


def ulid(millis: Column, seq: Column, entropy: Column) -> Column:
    """26 Crockford base-32 digits: 48 bits of time, 16 of sequence, 64 of entropy (a long)."""
    hexed = lambda c, n: F.lpad(F.substring(F.hex(c), -n, n), n, "0")
    # 5 hex digits make 4 base-32 digits; 12 leading zero bits fill the 128 up to 140, of which the last 26 digits count
    bits = F.concat(F.lit("000"), hexed(millis, 12), hexed(seq, 4), hexed(entropy, 16))
    digits = F.concat(*[F.lpad(F.conv(F.substring(bits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(7)])
    return F.translate(F.substring(digits, 3, 26), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "0123456789ABCDEFGHJKMNPQRSTVWXYZ")
