"""Ordered enums, access, trust and rights as column functions. Unknown values deny."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .temporal import instant, is_instant

# The ordered enums, lowest first.
CLASSIFICATIONS = ("public", "internal", "confidential", "restricted")
TRUST_TIERS = ("unverified", "machine-confirmed", "human-reviewed")
SEVERITIES = ("info", "warning", "error")
VERIFIER = r"^(?:human:[A-Za-z0-9._@/-]+|process:[A-Za-z0-9._@/-]+|[a-z][a-z0-9_-]*/[^/\s]+)$"


def rank(c: Column, values: tuple[str, ...]) -> Column:
    """Place in the enum from 0; null if unknown."""
    out = F.lit(None).cast("int")
    for i, v in enumerate(values):
        out = F.when(c == v, i).otherwise(out)
    return out


def named(rank_: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), rank_.cast("int") + 1)


def may_read(clearance: Column, held: Column, classification: Column, compartments: Column) -> Column:
    """The clearance is as high and every compartment is held; null or unknown denies."""
    high = rank(clearance, CLASSIFICATIONS) >= rank(classification, CLASSIFICATIONS)
    inside = F.size(F.array_except(F.coalesce(compartments, F.array().cast("array<string>")), F.coalesce(held, F.array().cast("array<string>")))) == 0
    return F.coalesce(high & inside, F.lit(False))


def most_restricted(classification: Column) -> Column:
    """Aggregate: the highest classification; null if any is unknown or there is none."""
    r = rank(classification, CLASSIFICATIONS)
    return F.when(~F.bool_or(r.isNull()), named(F.max(r), CLASSIFICATIONS))


def trust_tier(verified: Column, now: Column) -> Column:
    """Of array<struct<by, at>>: human-reviewed, machine-confirmed or unverified; future, malformed and impossible events don't count."""
    good = F.filter(F.coalesce(verified, F.array().cast("array<struct<by:string,at:string>>")), lambda e: F.coalesce(e["by"].rlike(VERIFIER), F.lit(False)) & F.coalesce(instant(e["at"]) <= now, F.lit(False)))
    return F.when(F.exists(good, lambda e: e["by"].startswith("human:")), "human-reviewed").when(F.size(good) > 0, "machine-confirmed").otherwise("unverified")


def rights_codes(rights: Column, scope: Column, transformation: Column, commercial: Column, now: Column) -> Column:
    """Codes of one material; rights is struct<redistribution, license, terms, derivative_use, commercial_use, expires_at>."""
    r = rights
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.array_compact(F.array(
        F.when(r.isNull() | (r["redistribution"] == "unknown") | (empty(r["license"]) & empty(r["terms"])), "RIGHTS_LEGAL_REVIEW_REQUIRED"),
        F.when(scope.isin("public", "external") & r["redistribution"].isin("prohibited", "metadata-only") & ~transformation.eqNullSafe("metadata-only"), "RIGHTS_REDISTRIBUTION_PROHIBITED"),
        F.when(transformation.eqNullSafe("derivative") & ~r["derivative_use"].eqNullSafe("allowed"), "RIGHTS_DERIVATIVE_PROHIBITED"),
        F.when(commercial.eqNullSafe(True) & ~r["commercial_use"].eqNullSafe("allowed"), "RIGHTS_COMMERCIAL_PROHIBITED"),
        F.when(~empty(r["expires_at"]) & ~is_instant(r["expires_at"]), "RIGHTS_EXPIRY_INVALID").when(instant(r["expires_at"]) <= now, "RIGHTS_EXPIRED"),
    ))
