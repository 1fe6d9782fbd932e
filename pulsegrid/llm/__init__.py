"""Training-data operators: dedup, decontamination, quality, tokens, WARC, PII."""
