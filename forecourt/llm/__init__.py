"""Training-data operators: archives, language, quality, duplicates, mixing, shards, search, tokens, licences.

Nothing else in the library imports this subpackage, and it imports nothing from the rest of
the library; only its query `pipeline` runs the module corpus_pipeline, which is counted as part of it.
"""
