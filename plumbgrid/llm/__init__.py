"""Training-data operators: scans, near-duplicates, decontamination, mixing, tokens."""
