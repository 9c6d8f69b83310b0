"""Operators for large-scale training data: near-duplicates, language, tokens, search, mixing, secrets,
packing and toxicity. Nothing else in the library imports this subpackage."""
