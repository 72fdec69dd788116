"""Training-data operators: search, quality, extraction, language models, sharding, privacy, mixing, tokens, near copies."""
