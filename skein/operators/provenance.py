"""Signed envelopes beside the graph: payloads, verification and the subject index."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import signed_payload
from .signatures import Registry

OUTCOMES = ("Valid", "BadSignature", "UnknownAlgorithm", "NoAttestations")


def with_payload(provenance: DataFrame) -> DataFrame:
    """Envelopes with `payload`, the bytes that each attestation signs."""
    payload = signed_payload(F.col("subject_id"), F.col("asserting_agent"), F.col("basis"), F.col("parent_hash"), F.col("algorithm"))
    return provenance.withColumn("payload", payload)


def verified(provenance: DataFrame, registry: Registry, strict: bool = False) -> DataFrame:
    """Envelopes with `outcome`: unknown algorithm, else no attestations, else a bad signature, else valid.

    All attestations must hold under the envelope's algorithm. strict: the first
    one must also be the asserting agent's. A null list holds no attestations; a
    null attestation, identity, signature or signed field is a bad signature.
    Signatures are checked in Arrow batches; there is no shuffle.
    """
    names = registry.names()

    @F.pandas_udf("boolean")
    def all_hold(algorithm: pd.Series, payload: pd.Series, attestations: pd.Series) -> pd.Series:
        out = []
        for name, message, given in zip(algorithm, payload, attestations):
            verifier = registry.for_algorithm(name)
            whole = verifier is not None and message is not None and given is not None
            out.append(whole and all(a is not None and a["identity"] is not None and a["signature"] is not None and verifier.verify(a["identity"], bytes(message), bytes(a["signature"])) for a in given))
        return pd.Series(out)

    rows = with_payload(provenance)
    good = all_hold("algorithm", "payload", "attestations")
    if strict:
        good = good & F.equal_null(F.get("attestations", F.lit(0))["identity"], F.col("asserting_agent"))
    outcome = F.when(~F.coalesce(F.col("algorithm").isin(names), F.lit(False)), "UnknownAlgorithm").when(F.coalesce(F.size("attestations"), F.lit(0)) < 1, "NoAttestations").when(good, "Valid").otherwise("BadSignature")
    return rows.withColumn("outcome", outcome).drop("payload")


def inserted(provenance: DataFrame, more: DataFrame) -> DataFrame:
    """Envelopes of `more` after those of `provenance`, per subject in order of ord."""
    last = provenance.groupBy("subject_id").agg((F.max("ord") + 1).alias("_shift"))
    shifted = more.join(last, "subject_id", "left").withColumn("ord", F.col("ord") + F.coalesce("_shift", F.lit(0))).drop("_shift")
    return provenance.unionByName(shifted)


def by_subject(provenance: DataFrame) -> DataFrame:
    """(subject_id, envelopes): one row a subject, in attach order."""
    own = F.struct("ord", *[c for c in provenance.columns if c not in ("ord", "subject_id")])
    return provenance.groupBy("subject_id").agg(F.array_sort(F.collect_list(own), lambda a, b: (a["ord"] > b["ord"]).cast("int") - (a["ord"] < b["ord"]).cast("int")).alias("envelopes"))


def for_subject(provenance: DataFrame, subject: str) -> DataFrame:
    return provenance.filter(F.col("subject_id") == subject)


def size(provenance: DataFrame) -> DataFrame:
    return provenance.agg(F.count("*").alias("envelopes"), (F.count("*") == 0).alias("is_empty"))
