"""Column functions: hashes, names, texts, samples."""
