"""Sensors, gates, review packets, publication, retention and erasure."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.canonical import canonical_json
from marlstone.functions.temporal import instant, is_date, is_instant, utc_date
from marlstone.functions.text import utf16_sorted
from marlstone.operators.stage import written

# Which built-in sensor runs at which gate.
GATE_SENSORS = {
    "secret-pattern": ("ingest", "review", "model-route", "publication"),
    "classification-declassification": ("ingest", "review", "retrieval", "model-route", "publication"),
    "rights-license": ("ingest", "review", "publication"),
    "external-model-route": ("model-route",),
    "retention-legal-hold": ("ingest", "erasure"),
    "prompt-injection": ("ingest", "review", "model-route"),
    "falsehood-provenance": ("review", "publication"),
}
REVIEWED_KINDS = ("concept", "proposal", "receipt")


@dataclass(frozen=True)
class Sensor:
    """A rule over a frame: evaluate gives subject and code of each finding."""

    id: str
    evaluate: Callable[[DataFrame], DataFrame]
    severity: str = "error"
    blocking: bool = True
    version: int = 1


class Registry:
    """Sensors and handlers by name; a plug-in can add, and can't replace a built-in."""

    def __init__(self):
        self.sensors: dict[str, Sensor] = {}
        self.handlers: dict[str, Callable] = {}

    def add(self, sensor: Sensor) -> None:
        if sensor.id in self.sensors:
            raise ValueError(f"the sensor {sensor.id} is there already")
        self.sensors[sensor.id] = sensor

    def run(self, frame: DataFrame, ids: list[str], twice: bool = True) -> DataFrame:
        """sensor, severity, blocking, subject, code. Every sensor runs twice, and one whose two runs differ, in either direction, is an error."""
        out = None
        for i in ids:
            s = self.sensors[i]
            found = s.evaluate(frame).select("subject", "code")
            if twice:
                first, second = written(found), written(s.evaluate(frame).select("subject", "code"))
                if not first.exceptAll(second).union(second.exceptAll(first)).isEmpty():
                    raise RuntimeError(f"the sensor {i} is not deterministic")
                found = first
            found = found.select(F.lit(i).alias("sensor"), F.lit(s.severity).alias("severity"), F.lit(s.blocking).alias("blocking"), "subject", "code")
            out = found if out is None else out.union(found)
        return out


def gate_matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, g) for s, gates in GATE_SENSORS.items() for g in gates], "sensor string, gate string")


def gate_report(findings: DataFrame, matrix: DataFrame, waivers: DataFrame, now: Column) -> DataFrame:
    """gate, subject, allowed, codes: a finding blocks at its sensor's gates unless an exact waiver is in force."""
    f = findings.join(F.broadcast(matrix), "sensor")
    w = waivers.where(instant(F.col("expires_at")) > now).select("sensor", "gate", "subject", F.lit(True).alias("waived")).distinct()
    f = f.join(w, ["sensor", "gate", "subject"], "left")
    blocks = F.col("waived").isNull() & F.col("blocking")
    return f.groupBy("gate", "subject").agg((~F.bool_or(blocks)).alias("allowed"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def propagated(materials: DataFrame, key: str) -> DataFrame:
    """key, compartments, obligations: distinct and sorted over a key's materials."""
    lists = materials.groupBy(key).agg(utf16_sorted(F.array_distinct(F.flatten(F.collect_set("compartments")))).alias("compartments"), utf16_sorted(F.array_distinct(F.flatten(F.collect_set("obligations")))).alias("obligations"))
    return lists


def stable_failures(c: Column, now: Column) -> Column:
    """Failures of a stable concept; c is struct<type, title, description, status, generated_by, generated_at, n_sources, freshness, stale_after>."""
    missing = [F.when(F.coalesce(c[f], F.lit("")) == "", F.lit(f"missing-{f}")) for f in ("type", "title", "description", "status")]
    fresh = c["freshness"].eqNullSafe("timeless") | (is_date(c["stale_after"]) & F.coalesce(c["stale_after"] > utc_date(now), F.lit(False)))
    return F.array_compact(F.array(*missing, F.when(c["generated_by"].isNull() | ~is_instant(c["generated_at"]), "missing-generation"), F.when(F.coalesce(c["n_sources"], F.lit(0)) == 0, "missing-source"), F.when(~fresh, "missing-future-freshness")))


def publication(p: DataFrame, now: Column) -> DataFrame:
    """proposal_id, allowed, failures of one-row-a-proposal bindings.

    p has structs packet, receipt, decision, freshness and current (each may be null)
    and target_status; hashes in them are those of whole artifacts. The codes are sorted.
    """
    packet, receipt, decision, current = (F.col(x) for x in ("packet", "receipt", "decision", "current"))
    differs = lambda a, b: ~a.eqNullSafe(b)
    stable, has = F.col("target_status").eqNullSafe("stable"), receipt.isNotNull()
    decided = has & decision.isNotNull()
    codes = [
        (differs(packet["proposal_hash"], F.col("proposal_hash")), "packet-proposal-drift"), (~has, "receipt-missing"), (has & decision.isNull(), "active-decision-missing"),
        (decided & (differs(decision["packet_hash"], packet["hash"]) | differs(decision["receipt_id"], receipt["id"]) | differs(decision["decision"], receipt["decision"])), "active-decision-drift"),
        (decided & ~F.coalesce(decision["proof"], F.lit(False)), "review-trust-proof-invalid"),
        (has & differs(receipt["subject"], F.col("subject")), "receipt-subject-drift"), (has & differs(receipt["packet_hash"], packet["hash"]), "packet-hash-drift"),
        (has & stable & ~F.coalesce(receipt["reviewer"].startswith("human:"), F.lit(False)), "human-review-required"),
        (packet["freshness_mode"].eqNullSafe("separate") & (F.col("freshness").isNull() | differs(F.col("freshness")["packet_hash"], packet["hash"]) | differs(F.col("freshness")["value_hash"], current["freshness_hash"])), "freshness-authorization-invalid"),
        (packet["freshness_mode"].eqNullSafe("separate") & ~F.coalesce(F.col("freshness")["proof"], F.lit(False)), "freshness-trust-proof-invalid"),
        (differs(current["review_hash"], packet["review_hash"]), "review-content-drift"), (differs(packet["after_hash"], packet["review_hash"]), "packet-review-hash-invalid"),
        (differs(current["revision"], packet["revision"]), "target-revision-drift"), (differs(current["concept_sources"], packet["sources"]), "concept-source-drift"), (F.coalesce(packet["blocked"], F.lit(True)), "blocking-sensor"),
    ]
    for name in ("review_hash", "sources", "dependencies", "profile", "policies"):
        word = {"review_hash": "review", "sources": "source", "dependencies": "dependency", "policies": "policy"}.get(name, name)
        codes.append((has & differs(receipt[name], packet[name]), f"{word}-binding-drift"))
        if name != "review_hash":
            codes.append((differs(current[name], packet[name]), f"current-{word}-drift"))
    named = [F.when(decided & (decision["decision"] != "approved"), F.concat(F.lit("active-decision-"), decision["decision"])), F.when(has & (receipt["decision"] != "approved"), F.concat(F.lit("receipt-"), receipt["decision"]))]
    every = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in codes], *named)), F.when(stable, stable_failures(current["concept"], now)).otherwise(F.array().cast("array<string>")))))
    failures = F.when(current.isNull(), F.array(F.lit("current-context-invalid"))).otherwise(every)
    return p.select("proposal_id", (F.size(failures) == 0).alias("allowed"), failures.alias("failures"))


def retention(impacted: DataFrame, holds: DataFrame, now: Column, immediate: bool = False) -> DataFrame:
    """surface_id, kind, blocked_by (hold, retention or null): what keeps an erasure from a surface.

    impacted: surface_id, kind, source_id, retained_until; holds: source_id, kinds (empty: all), active.
    """
    h = holds.where("active").select("source_id", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    held = impacted.join(h, "source_id").where((F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind"))).select("surface_id").distinct().withColumn("held", F.lit(True))
    kept = F.lit(not immediate) & F.coalesce(instant(F.col("retained_until")) > now, F.lit(False))
    return impacted.join(held, "surface_id", "left").select("surface_id", "kind", F.when(F.col("held"), "hold").when(kept, "retention").alias("blocked_by"))


def treatment(kind: Column, action: str) -> Column:
    """The state of a surface after revoke or erase."""
    if action == "revoke":
        return F.when(kind.isin(*REVIEWED_KINDS), "review-required").otherwise("invalidated")
    return F.when(kind.isin("audit", "log"), "tombstoned").otherwise("purged")


def treated_counts(treated: DataFrame) -> DataFrame:
    """kind, n with a total (kind null)."""
    return treated.rollup("kind").agg(F.count("*").alias("n"))


def proof(key: bytes, value) -> str:
    """HMAC-SHA256 of a value's canonical form; keys stay on the driver."""
    return hmac.new(key, canonical_json(value).encode(), hashlib.sha256).hexdigest()


def proven(key: bytes, value, claimed: str) -> bool:
    return hmac.compare_digest(proof(key, value), claimed)
