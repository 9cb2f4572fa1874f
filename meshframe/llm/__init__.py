"""Training-data operators: near-duplicates, mixing, tokens, PII, URL rules, shards and quality."""
