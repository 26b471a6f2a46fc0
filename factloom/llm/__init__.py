"""Training-data operators: near-dedup, quality, packing, PII, fingerprints,
token counts, mixing, toxicity and URL filters.  Nothing outside imports it."""
