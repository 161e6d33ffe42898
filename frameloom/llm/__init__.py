"""Training-data operators: deduplication, classification, decontamination and packing at corpus scale."""
