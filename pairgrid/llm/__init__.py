"""Training-data operators: deduplication, privacy, decontamination, extraction,
toxicity, sharding, fingerprints, similarity join and tokenisation.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
