"""Write and import guards: the first rule that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import KINDS, MAX_BODY, MAX_ORIGIN, MAX_SKEW_S, SOURCES, STATUSES
from .timeutil import iso_seconds

#: Our own list: cloud access keys, provider tokens, private-key blocks, JSON web tokens.
SECRETS = {
    "cloud access key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bAIza[0-9A-Za-z_-]{35}\b",
    "provider token": r"\b(?:gh[pousr]_[0-9A-Za-z]{20,}|github_pat_[0-9A-Za-z_]{20,}|glpat-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|sk-[0-9A-Za-z]{32,}|npm_[0-9A-Za-z]{36})",
    "private key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "JSON web token": r"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{4,}",
}


def secret_kind(c: Column) -> Column:
    """What kind of credential the text holds, else null."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(SECRETS.items()):
        out = F.when(c.rlike(pattern), kind).otherwise(out)
    return out


def _first(*rules: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for rule, name in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def write_reject(kind: Column, body: Column, source: Column, origin: Column, origin_taken: Column, evidence_cmd: Column, evidence_output: Column) -> Column:
    has_evidence = evidence_cmd.isNotNull()
    return _first(
        (~kind.isin(KINDS), "kind"),
        (~source.isin(SOURCES), "source"),
        ((source == "verified") & ~has_evidence, "verified_without_evidence"),
        (F.trim(origin) == "", "origin_empty"),
        (F.octet_length(origin) > MAX_ORIGIN, "origin_size"),
        (secret_kind(origin).isNotNull(), "origin_secret"),
        (origin_taken, "origin_duplicate"),
        (F.trim(body) == "", "body_empty"),
        (F.octet_length(body) > MAX_BODY, "body_size"),
        (secret_kind(body).isNotNull(), "body_secret"),
        (secret_kind(evidence_output).isNotNull(), "evidence_output_secret"),
        (F.trim(evidence_cmd) == "", "evidence_command_empty"),
        (secret_kind(evidence_cmd).isNotNull(), "evidence_command_secret"),
    )


def import_reject(r: dict[str, Column], now: Column) -> Column:
    """The static rules of an import line, in order; r: its columns by name."""
    body, cmd, source = F.coalesce(r["body"], F.lit("")), F.coalesce(r["evidence_cmd"], F.lit("")), F.coalesce(r["source"], F.lit("explicit"))
    at = iso_seconds(F.coalesce(r["updated_at"], F.lit("")))
    return _first(
        (at.isNull(), "updated_at"),
        (at > iso_seconds(now) + MAX_SKEW_S, "future"),
        (secret_kind(body).isNotNull() | secret_kind(cmd).isNotNull(), "secret"),
        (F.octet_length(body) > MAX_BODY, "body_size"),
        (~source.isin(SOURCES), "source"),
        ((source == "verified") & (cmd == ""), "verified_without_evidence"),
        (~F.coalesce(r["kind"], F.lit("insight")).isin(KINDS), "kind"),
        (~F.coalesce(r["status"], F.lit("active")).isin(STATUSES), "status"),
        (F.trim(body) == "", "body_empty"),
        ((F.octet_length(r["origin"]) > MAX_ORIGIN) | secret_kind(r["origin"]).isNotNull(), "origin"),
    )


def bad_path(c: Column) -> Column:
    """The part of the path guard that needs no file system: empty, absolute, or leaving the root."""
    return F.coalesce((F.trim(c) == "") | c.rlike(r"^(?:[\\/]|[A-Za-z]:)") | c.rlike(r"(?:^|[\\/])\.\.(?:[\\/]|$)"), F.lit(True))
