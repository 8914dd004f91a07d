"""Training-data operators: packing, dedup, fingerprints, token counts, filters, mixing, personal data."""
