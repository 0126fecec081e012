"""Index, provenance, trust, signatures, container and spectra on small inputs."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from skein import schema
from skein.operators import provenance as P
from skein.operators import lattice, spectral
from skein.operators.graph import Graph
from skein.operators.index import NodeIndex
from skein.operators.signatures import SCHEMES, Ed25519, Hybrid, MockScheme, Registry, SecretKeySigner
from skein.operators.trust import TrustStore, authorized, chained, verify_authorized
from skein.sources.artifact import Artifact, ArtifactError, parse, read_edges, read_envelopes, read_index, read_nodes
from test_graph import make


def ids(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "node_id string, first_seq long")


def doomed(spark, *names):
    return ids(spark, *names).withColumnRenamed("first_seq", "seq")


def pairs(spark, *named):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(named)], "from_id string, into_id string, seq long")


def live(index):
    return {r.node_id: r.u64 for r in index.table.filter("state = 'live'").collect()}


def test_intern_tombstone_merge_and_resolve(spark):
    index = NodeIndex.empty(spark).intern(ids(spark, "a", "b", "a", "c"))
    assert live(index) == {"a": 0, "b": 1, "c": 2} and index.capacity == 3
    index = index.tombstone(doomed(spark, "a", "nobody")).intern(ids(spark, "d", "a"))
    assert live(index) == {"b": 1, "c": 2, "d": 3, "a": 4}
    assert index.u64_of(ids(spark, "zz")).first().u64 is None
    merged = index.merge(pairs(spark, ("b", "c"))).merge(pairs(spark, ("c", "d")))
    got = {r.u64: r.resolved for r in merged.resolve().collect()}
    assert got[1] == 3 and got[2] == 3 and got[0] == 0 and merged.capacity == 5
    assert {r.u64 for r in merged.tombstones().collect()} == {0, 1, 2}
    assert {r.u64: r.dead for r in merged.is_tombstoned(spark.range(5).withColumnRenamed("id", "u64")).collect()} == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_merge_interns_the_survivor_first_and_itself_is_nothing(spark):
    index = NodeIndex.empty(spark).merge(pairs(spark, ("p", "q")))
    assert live(index) == {"q": 0} and {r.u64: r.resolved for r in index.resolve().collect()} == {0: 0, 1: 0}
    assert live(index.merge(pairs(spark, ("q", "q")))) == {"q": 0}


def one_by_one(named):
    """({u64: state}, {u64: resolved}) by pairs taken one after the other."""
    live, into, state = {}, {}, {}
    for a, b in named:
        for x in (b, a):
            if x not in live:
                live[x] = len(state)
                state[live[x]] = "live"
        if a != b:
            into[live[a]] = live[b]
            state[live.pop(a)] = "merged"
    end = {}
    for u in state:
        end[u] = u
        while end[u] in into:
            end[u] = into[end[u]]
    return state, end


@pytest.mark.parametrize("named", [[("b", "c"), ("a", "b")], [("a", "b"), ("a", "c"), ("b", "a"), ("c", "c"), ("a", "b"), ("b", "c"), ("c", "a")]])
def test_merges_of_one_call_that_hang_together(spark, named):
    state, end = one_by_one(named)
    once = NodeIndex.empty(spark).merge(pairs(spark, *named))
    several = NodeIndex.empty(spark)
    for pair in named:
        several = several.merge(pairs(spark, pair))
    for index in (once, several):
        assert {r.u64: r.state for r in index.table.collect()} == state and {r.u64: r.resolved for r in index.resolve().collect()} == end
    assert sorted((r.u64, r.died_seq) for r in once.tombstones().collect()) == sorted((r.u64, r.died_seq) for r in several.tombstones().collect())


def test_snapshot(spark, tmp_path):
    index = NodeIndex.empty(spark).intern(ids(spark, "a", "b")).tombstone(doomed(spark, "a"))
    index.snapshot(str(tmp_path / "index"))
    back = NodeIndex.restore(spark, str(tmp_path / "index"))
    assert (back.capacity, back.deaths) == (2, 1) and sorted(back.table.collect()) == sorted(index.table.collect())


AGENT, PARENT = "harbour:pilot", bytes.fromhex("0a1b2c3d4e")


def envelope(spark, subject="link:q7", agent=AGENT, basis=2, parent=PARENT, algorithm="mock-v1", signed=None):
    return spark.createDataFrame([(subject, 0, agent, basis, bytearray(parent), algorithm, [(i, "agent-signs-action", bytearray(s)) for i, s in signed or []])], schema.PROVENANCE)


def checksum(*parts):
    h = 1469598103934665603
    for byte in b"".join(parts):
        h = (h ^ byte) * 1099511628211 % 2**64
    return h.to_bytes(8, "little")


PAYLOAD = b"".join(struct.pack("<I", len(x)) + x for x in (b"link:q7", AGENT.encode(), b"\x02", PARENT, b"mock-v1"))
GOOD = (AGENT, checksum(AGENT.encode(), PAYLOAD))


def test_payload_and_mock_signature(spark):
    row = P.with_payload(envelope(spark)).first()
    assert bytes(row.payload) == PAYLOAD and MockScheme().sign(GOOD[0], bytes(row.payload)) == GOOD[1]


@pytest.mark.parametrize(
    "change, registry, want",
    [
        ({}, True, "Valid"), ({"basis": 0}, True, "BadSignature"), ({"parent": PARENT[:-1]}, True, "BadSignature"), ({"subject": "link:q8"}, True, "BadSignature"),
        ({}, False, "UnknownAlgorithm"), ({"signed": []}, True, "NoAttestations"), ({"signed": [], "algorithm": "other"}, True, "UnknownAlgorithm"), ({"signed": [GOOD, ("x", b"bad")]}, True, "BadSignature"),
    ],
)
def test_verify(spark, change, registry, want):
    rows = envelope(spark, **{"signed": [GOOD], **change})
    assert P.verified(rows, Registry([MockScheme()] if registry else [])).first().outcome == want


def test_strict_ties_the_first_attestation_to_the_agent(spark):
    other = ("someone", MockScheme().sign("someone", PAYLOAD))
    rows = envelope(spark, signed=[other])
    registry = Registry([MockScheme()])
    assert P.verified(rows, registry).first().outcome == "Valid" and P.verified(rows, registry, strict=True).first().outcome == "BadSignature"


def test_envelopes_with_nulls(spark):
    rows = [
        ("a", 0, AGENT, 2, bytearray(PARENT), "mock-v1", None), ("b", 0, AGENT, 2, bytearray(PARENT), "mock-v1", [(AGENT, "r", None)]), ("c", 0, AGENT, 2, bytearray(PARENT), "mock-v1", [None]),
        ("d", 0, AGENT, 2, None, "mock-v1", [(AGENT, "r", bytearray(b"x"))]), ("e", 0, AGENT, 2, bytearray(PARENT), None, []), ("f", 0, None, 2, bytearray(PARENT), "mock-v1", [(None, None, bytearray(b"x"))]),
    ]
    frame = spark.createDataFrame(rows, schema.PROVENANCE)
    for strict in (False, True):
        got = {r.subject_id: r.outcome for r in P.verified(frame, Registry([MockScheme()]), strict).collect()}
        assert got == {"a": "NoAttestations", "b": "BadSignature", "c": "BadSignature", "d": "BadSignature", "e": "UnknownAlgorithm", "f": "BadSignature"}


def test_subject_index(spark):
    both = P.inserted(envelope(spark), envelope(spark).unionByName(envelope(spark, subject="n")))
    assert {(r.subject_id, len(r.envelopes)) for r in P.by_subject(both).collect()} == {("link:q7", 2), ("n", 1)}
    assert P.for_subject(both, "none").count() == 0 and P.size(both).first().envelopes == 3


def test_ed25519_follows_the_published_vectors():
    # RFC 8032, section 7.1, tests 1 and 2.
    for secret, public, message, signature in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ):
        s, p, m, g = map(bytes.fromhex, (secret, public, message, signature))
        assert Ed25519.public_key(s) == p and Ed25519.sign(s, m) == g and Ed25519.verify(p, m, g)
        assert not Ed25519.verify(p, m + b"x", g) and not Ed25519.verify(p, m, g[:-1])


@pytest.mark.parametrize("name", ["ml-dsa-65", Hybrid.name])
def test_lattice_and_hybrid_signatures(name):
    scheme, secret = SCHEMES[name], bytes(range(32))
    key = scheme.public_key(secret)
    for message in (b"", b"m" * 300):
        signature = scheme.sign(secret, message)
        assert scheme.verify(key, message, signature) and not scheme.verify(key, message + b"!", signature)
        for at in (0, 60, len(signature) - 1):
            spoilt = bytearray(signature)
            spoilt[at] ^= 1
            assert not scheme.verify(key, message, bytes(spoilt))
    assert not scheme.verify(scheme.public_key(bytes(32)), b"", scheme.sign(secret, b"")) and not scheme.verify(key, b"", b"")


def test_lattice_sizes_and_transform():
    public, secret = lattice.MLDSA65.key_pair(bytes(32))
    assert (len(public), len(secret), len(lattice.MLDSA65.sign(secret, b"x"))) == (1952, 4032, 3309)
    a, b = np.random.default_rng(0).integers(0, lattice.Q, (2, 256))
    full = [sum(int(a[i]) * int(b[k - i]) for i in range(max(0, k - 255), min(k, 255) + 1)) for k in range(511)]
    want = [(full[k] - (full[k + 256] if k < 255 else 0)) % lattice.Q for k in range(256)]
    assert lattice.inverse(lattice.transform(a) * lattice.transform(b) % lattice.Q).tolist() == want


def store() -> tuple[TrustStore, dict[str, bytes]]:
    secrets = {name: bytes([i]) * 32 for i, name in enumerate(("root", "dock", "crane", "stowaway"))}
    keys = {n: Ed25519.public_key(s) for n, s in secrets.items()}
    return TrustStore("root", "ed25519", keys["root"]).add_tenant("dock", "ed25519", keys["dock"], "east").add_agent("crane", "ed25519", keys["crane"], "dock"), secrets


def test_trust_store_and_tables_agree(spark):
    trusted, _ = store()
    assert [trusted.chains_to_root(x) for x in ("root", "dock", "crane", "stowaway")] == [True, True, True, False]
    assert [trusted.is_authorized(*x) for x in (("crane", "east"), ("crane", "west"), ("root", "east"), ("dock", "east"))] == [True, False, False, True]
    table = trusted.table(spark)
    assert {r.identity for r in chained(table, "root").collect()} == {"root", "dock", "crane"}
    assert {tuple(r) for r in authorized(table, "root").collect()} == {("dock", "east"), ("crane", "east")}
    assert {r.identity for r in chained(table.filter("identity <> 'dock'"), "root").collect()} == {"root"}


def test_deep_delegation_null_keys_and_cycles(spark):
    rows = [("root", "a", bytearray(b"k"), None, None), *[(f"d{i}", "a", bytearray(b"k"), f"d{i - 1}" if i else "root", None) for i in range(20)]]
    rows += [("keyless", "a", None, "root", "east"), ("below", "a", bytearray(b"k"), "keyless", None), ("x", "a", bytearray(b"k"), "y", None), ("y", "a", bytearray(b"k"), "x", None)]
    table = spark.createDataFrame(rows, schema.TRUST_IDS)
    assert {r.identity: r.depth for r in chained(table, "root").collect()} == {"root": 0, **{f"d{i}": i + 1 for i in range(20)}}
    assert authorized(table, "root").count() == 0 and chained(table, "nobody").count() == 0


@pytest.mark.parametrize("signer, namespace, want", [("crane", "east", "Authorized"), ("crane", "west", "Unauthorized"), ("stowaway", "east", "BadSignature")])
def test_authorised_verdict(spark, signer, namespace, want):
    trusted, secrets = store()
    unsigned = envelope(spark, agent="crane", algorithm="ed25519")
    payload = bytes(P.with_payload(unsigned).first().payload)
    signature = SecretKeySigner("ed25519", secrets[signer]).sign(signer, payload)
    rows = envelope(spark, agent="crane", algorithm="ed25519", signed=[(signer, signature)])
    assert verify_authorized(rows, F.lit(namespace), trusted.registry(), trusted).first().outcome == want


A1 = bytes.fromhex(
    "454d4752415048000100000022000000020000000100000061010000006100000000000100000062010000006200000000001600000001000000010000006101000000620300000072656c00180000000000000000000000000000000000000000000000000000000400000000000000"
)


def test_container_bytes(spark):
    graph = make(spark, [("b", "b", ""), ("a", "a", "")], [("a", "b", "rel", 0)])
    assert Artifact.of(graph).to_bytes() == A1


@pytest.mark.parametrize(
    "raw, kind",
    [(b"X" + A1[1:], "BadMagic"), (A1[:8] + b"\x02" + A1[9:], "UnsupportedVersion"), (A1[:-5], "Truncated"), (A1 + b"\x00", "TrailingBytes"), (A1[:7], "Truncated"), (A1.replace(b"rel\x00", b"rel\x63"), "BadEnumTag"), (A1.replace(b"\x01\x00\x00\x00a", b"\x01\x00\x00\x00\xff", 1), "Utf8")],
)
def test_container_refuses(raw, kind):
    with pytest.raises(ArtifactError) as e:
        parse(raw)
    assert e.value.kind == kind


def test_container_round_trip(spark, tmp_path):
    graph = make(spark, [("a", 'say "hi"', "k", "src"), ("b", "é", "")], [("a", "b", "r", 3), ("a", "ghost", "r", 6)])
    index = NodeIndex.empty(spark).intern(ids(spark, "a", "b", "c", "d")).tombstone(doomed(spark, "c")).merge(pairs(spark, ("d", "b")))
    signed = envelope(spark, subject="b", signed=[("x", bytes.fromhex("13579bdf02468ace"))])
    made = Artifact.of(graph, index, signed.unionByName(envelope(spark, subject="a")))
    raw = made.to_bytes()
    back = Artifact.from_bytes(spark, raw)
    assert back.to_bytes() == raw and back.index.capacity == 4
    assert {r.u64: r.resolved for r in back.index.resolve().collect()} == {0: 0, 1: 1, 2: 2, 3: 1}
    text = made.to_json()
    assert all(x in text for x in (f'"{PARENT.hex()}"', "13579bdf02468ace", '\\"hi\\"', '"tombstoned": [2, 3]', '"merged_into": {"3": 1}', "Inferred(Reasonable)"))
    (tmp_path / "one.bin").write_bytes(raw)
    (tmp_path / "two.bin").write_bytes(A1)
    many = str(tmp_path)
    assert read_edges(spark, many).count() == 3 and {(r.id, r.source) for r in read_nodes(spark, many).collect()} == {("a", "src"), ("b", None), ("a", None)}
    kept = lambda frame: sorted(map(str, frame.collect()))
    assert kept(read_index(spark, many).drop("path")) == kept(back.index.table)
    assert kept(read_envelopes(spark, many).drop("path")) == kept(back.provenance)


def test_the_last_record_of_a_node_counts(spark):
    node = lambda *fields: b"".join(struct.pack("<I", len(x)) + x for x in fields) + b"\x00"
    body = struct.pack("<I", 2) + node(b"a", b"old", b"") + node(b"a", b"new", b"k")
    rest = A1[16 + struct.unpack("<I", A1[12:16])[0] :]
    back = Artifact.from_bytes(spark, A1[:12] + struct.pack("<I", len(body)) + body + rest)
    assert [(r.id, r.label, r.kind) for r in back.graph.nodes.collect()] == [("a", "new", "k")]


TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f")]


def linked(spark, names, edges):
    return make(spark, [(n, n, "") for n in names], [(a, b, "r", 0) for a, b in edges])


def test_two_nodes(spark):
    assert spectral.algebraic_connectivity(linked(spark, "ab", [("a", "b"), ("b", "a")])) == pytest.approx(2, abs=1e-6)


def test_disconnected_triangles_take_opposite_signs(spark):
    graph = linked(spark, "abcdef", TRIANGLES)
    assert spectral.algebraic_connectivity(graph) == pytest.approx(0, abs=1e-6)
    v = {r.id: r.value for r in spectral.fiedler_vector(graph).collect()}
    assert len({np.sign(v[x]) for x in "abc"}) == 1 and len({np.sign(v[x]) for x in "def"}) == 1 and np.sign(v["a"]) == -np.sign(v["d"])


def test_barbell(spark):
    graph = linked(spark, "abcdef", [*TRIANGLES, ("a", "d")])
    assert spectral.algebraic_connectivity(graph) == pytest.approx(0.204666, abs=1e-6)
    v = {r.id: r.value for r in spectral.fiedler_vector(graph).collect()}
    assert np.sign(v["b"]) == -np.sign(v["e"]) and abs(v["a"]) == pytest.approx(0.322, abs=1e-3)
    frame, values = spectral.spectral_embedding(graph, 3)
    assert values == sorted(values) and all(len(r.coords) == 3 for r in frame.collect()) and frame.count() == 6


@pytest.mark.parametrize("names, k, kind", [("", 1, "EmptyGraph"), ("a", 1, "TooFewNodes"), ("abc", 3, "TooFewNodes")])
def test_spectral_errors(spark, names, k, kind):
    graph = linked(spark, names, []) if names else Graph.empty(spark)
    with pytest.raises(spectral.SpectralError) as e:
        spectral.spectral_embedding(graph, k)
    assert e.value.kind == kind
