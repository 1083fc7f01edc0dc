"""Constants of the retrieval engine. Fixed values that results depend on; each can be overridden per call."""

CHUNK_TARGET_WORDS, CHUNK_OVERLAP_WORDS = 250, 50
TOP_K, RRF_K, POOL_K = 5, 60, 20
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
GRAPH_HOPS, GRAPH_MAX_CHUNKS = 2, 40
MAX_SUB_QUESTIONS, MAX_CORRECTIONS, RELATION_WORDS = 3, 2, 4
GRADE_CORRECT_FROM = 0.3
COMMUNITY_EDGES, COMMUNITY_EXCERPT, PROMPT_PREVIEW, VECTOR_PREVIEW = 15, 300, 200, 8
FAITHFULNESS_GAP, TONE_GOOD, TONE_WARN = 0.2, 0.8, 0.5
MIN_NOTES, MIN_ENTITIES, ENTITY_NOTES, WORD_BAND = 55, 40, 3, (250, 700)
SCORE_DIGITS = 6
ARCHITECTURES = ("naive", "hybrid", "hyde", "corrective", "graph", "agentic", "adaptive")
NODE_KINDS = (
    "embed_query", "retrieve_dense", "retrieve_sparse", "fuse", "rerank", "generate", "generate_hypothetical",
    "grade", "rewrite", "graph_seed", "graph_expand", "plan", "reflect", "route",
)
