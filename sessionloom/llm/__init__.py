"""Training-data operators: near-duplicates, search, language, text extraction, packing, mixing."""
