"""Training-data operators: language id, fingerprints, scoring, deduplication, search, filters, formatting, mixing."""
