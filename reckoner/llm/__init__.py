"""Training-data operators: archives, fingerprints, extraction, filters, tokens."""
