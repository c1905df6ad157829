"""Training-data operators: format duplicates, canonical mapping, linkage, set similarity, packing, mixing, language."""
