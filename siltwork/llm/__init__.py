"""Training-data operators: deduplication, decontamination, packing, safety, extraction, scoring."""
