"""Operators for large text corpora: rules, deduplication, decontamination, mixing, scoring and sharding."""
