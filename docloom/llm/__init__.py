"""Training-data operators: deduplication, extraction, scoring, encoding and packing of text corpora."""
