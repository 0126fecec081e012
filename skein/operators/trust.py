"""Trust stores: keys, delegation from a root, namespaces, and the authorised verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..session import Grown, settle
from .provenance import verified
from .signatures import SCHEMES, Registry, TrustedVerifier


class TrustStore:
    """Identities with keys, parents and namespaces, under one root.

    A store is small, driver-side state (an organisation's keys); its tables are
    sent to executors as such. Revoke by building a store without an identity.
    """

    def __init__(self, root: str, algorithm: str, key: bytes) -> None:
        self.root = root
        self.keys: dict[str, tuple[str, bytes]] = {root: (algorithm, key)}
        self.parents: dict[str, str] = {}
        self.scopes: dict[str, str] = {}

    def add_tenant(self, tenant: str, algorithm: str, key: bytes, namespace: str) -> TrustStore:
        self.keys[tenant], self.parents[tenant], self.scopes[tenant] = (algorithm, key), self.root, namespace
        return self

    def add_agent(self, agent: str, algorithm: str, key: bytes, tenant: str) -> TrustStore:
        self.keys[agent], self.parents[agent] = (algorithm, key), tenant
        return self

    def public_key(self, identity: str) -> tuple[str, bytes] | None:
        return self.keys.get(identity)

    def chains_to_root(self, identity: str) -> bool:
        """Every identity up to the root has a known key, and there is no cycle."""
        seen = set()
        while identity in self.keys and identity not in seen:
            if identity == self.root:
                return True
            seen.add(identity)
            identity = self.parents.get(identity, "")
        return False

    def is_authorized(self, identity: str, namespace: str) -> bool:
        """Chained, and its own namespace (or else its parent's) is `namespace`."""
        scope = self.scopes.get(identity, self.scopes.get(self.parents.get(identity, "")))
        return scope == namespace and self.chains_to_root(identity)

    def registry(self) -> Registry:
        return Registry(TrustedVerifier(name, self.keys, self.chains_to_root) for name in SCHEMES)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, a, bytearray(k), self.parents.get(i), self.scopes.get(i)) for i, (a, k) in self.keys.items()]
        return spark.createDataFrame(rows, schema.TRUST_IDS)


def chained(identities: DataFrame, root: str) -> DataFrame:
    """(identity, depth) of the rows of trust_ids that chain to the root, from the root down.

    Only identities with a known key count, at every step. A round for each level
    of delegation, each of them written; a cycle never hangs on the root.
    """
    keyed = settle(identities.filter(F.col("identity").isNotNull() & F.col("public_key").isNotNull()).select("identity", "parent").distinct())
    level = settle(keyed.filter(F.col("identity") == root).select("identity", F.lit(0).alias("depth")).distinct())
    known, depth = Grown(level), 0
    while not level.isEmpty():
        depth += 1
        below = keyed.filter(F.col("identity") != root).join(level.select(F.col("identity").alias("parent")), "parent", "left_semi").select("identity", F.lit(depth).alias("depth")).distinct()
        level = settle(below.join(known.frame().select("identity"), "identity", "left_anti"))
        known.add(level)
    return known.frame()


def authorized(identities: DataFrame, root: str) -> DataFrame:
    """(identity, namespace): what each chained identity may assert in."""
    parent = identities.select(F.col("identity").alias("parent"), F.col("scope").alias("parent_scope"))
    scoped = identities.join(parent, "parent", "left").select("identity", F.coalesce("scope", "parent_scope").alias("namespace"))
    return scoped.filter("namespace IS NOT NULL").join(chained(identities, root).select("identity"), "identity", "left_semi")


def verify_authorized(provenance: DataFrame, namespace: Column, registry: Registry, store: TrustStore, strict: bool = False) -> DataFrame:
    """`verified` rows with `outcome` Authorized, Unauthorized, BadSignature, UnknownAlgorithm or NoAttestations."""
    spark = provenance.sparkSession
    allowed = authorized(store.table(spark), store.root).select(F.col("identity").alias("asserting_agent"), F.col("namespace").alias("_allowed"))
    rows = verified(provenance, registry, strict).withColumn("_asked", namespace)
    joined = rows.join(F.broadcast(allowed), (rows["asserting_agent"] == allowed["asserting_agent"]) & (F.col("_asked") == F.col("_allowed")), "left").drop(allowed["asserting_agent"])  # a trust store is driver-side state
    outcome = F.when(F.col("outcome") != "Valid", F.col("outcome")).when(F.col("_allowed").isNotNull(), "Authorized").otherwise("Unauthorized")
    return joined.withColumn("outcome", outcome).drop("_asked", "_allowed")
