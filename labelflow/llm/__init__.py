"""Training-data operators: sharding, token counts, suffix-array and SimHash deduplication, HTML
extraction, SentencePiece encoding, quality scoring, exact top-k search, source mixing and
document fingerprints. Nothing outside this subpackage imports it; ``queries.py`` holds the
registered queries."""
