"""Training-data operators: text fingerprints, dedup, scoring, scanning, tokenising and packing."""
