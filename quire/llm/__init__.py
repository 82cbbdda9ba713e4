"""Training-data operators: dedup, fingerprints, extraction, filters, mixing."""
