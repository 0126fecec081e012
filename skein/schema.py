"""Schemas of the graph tables and the confidence rubric."""

NODES = "id string, label string, kind string, source string"
EDGES = "source string, target string, relation string, confidence int, seq long"
INGEST_LOG = "seq long, op string, id string, label string, kind string, node_source string, source string, target string, relation string, confidence int"
NODE_INDEX = "u64 long, node_id string, state string, into_u64 long, died_seq long"
ATTESTATION = "identity string, role string, signature binary"
PROVENANCE = f"subject_id string, ord long, asserting_agent string, basis int, parent_hash binary, algorithm string, attestations array<struct<{', '.join(x.replace(' ', ':') for x in ATTESTATION.split(', '))}>>"
TRUST_IDS = "identity string, algorithm string, public_key binary, parent string, scope string"

# Confidence tags 0..6 with their names, scores and trust levels.
CONFIDENCE_NAMES = ("Extracted", "Inferred(Strong)", "Inferred(Clear)", "Inferred(Reasonable)", "Inferred(Weak)", "Inferred(Tenuous)", "Ambiguous")
SCORES = (1.0, 0.95, 0.85, 0.75, 0.65, 0.55, 0.2)
TRUST = (3, 2, 2, 1, 1, 1, 0)
TRUST_NAMES = ("Untrusted", "Low", "Medium", "High")
TRUST_MAP_VERSION = 1
