"""Training-data operators: deduplication, decontamination, mixing, extraction, privacy, search, classifiers."""
