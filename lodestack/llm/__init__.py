"""Training-data operators (licences, tokens, leaks, shards, toxicity, pages, languages, language models, copies, vectors)."""
