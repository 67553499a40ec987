"""Record schema and the constants that define results."""

RECORD = (
    "id string, memory_type short, text string, index_text string, vector array<float>, tags array<string>, entity_ids array<string>, "
    "occurred_start long, occurred_end long, mentioned_at long, updated_at long, event_at long, proof_count long, "
    "semantic_out array<struct<target:string,weight:double>>, causal_out array<struct<target:string,link_type:string,weight:double>>, "
    "metadata map<string,string>, write_seq long"
)
FIELDS = (
    "id", "memory_type", "text", "index_text", "vector", "tags", "entity_ids", "occurred_start", "occurred_end", "mentioned_at", "updated_at", "event_at",
    "proof_count", "semantic_out", "causal_out", "metadata", "write_seq",
)

LINK_THRESHOLD, MAX_LINKS, LINK_DEPTH = 0.7, 5, 9
SPREAD_MS, MAX_TEMPORAL_LINKS = 86_400_000, 20
SEED_FLOOR, MAX_SEEDS, PER_ENTITY, PER_TEMPORAL, GRAPH_BUDGET = 0.3, 20, 200, 200, 50
POOL, ENTRY_POINTS, BUCKETS, WINDOW_CAP = 60, 10, 8, 256
NO_DATE_ENTRY, NO_DATE_NEIGHBOUR, DECAY = 0.5, 0.3, 0.7
RRF_K, DEFAULT_DEPTH = 60, 100
BM25_K1, BM25_B = 1.2, 0.75
MAX_PROOF = 4_294_967_295
SCAN_DEFAULT, SCAN_MAX = 50, 1000
ENTITY_LINK_CAP = 10
EDGE_LIMIT = 10_000
STOPWORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with this these those or but not have had which we they "
    "their them our you your can could would should than then there here into over under such been being also"
).split()
