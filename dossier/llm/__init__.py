"""Training-data operators: mixing, decontamination, filtering, dedup, formatting and storage."""
