"""Training-data operators: scoring, joins, language, near-dedup, PII, decontamination, fixity, packing."""
