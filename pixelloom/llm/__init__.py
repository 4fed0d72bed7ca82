"""Training-data operators: token counts, decontamination, extraction, scoring, packing and more."""
