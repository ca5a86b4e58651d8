"""Training-data operators: mixing, fingerprints, near-duplicate joins, scans, WARC, language ID, BPE."""
