"""Column functions: text normalization, string similarity, metrics."""
