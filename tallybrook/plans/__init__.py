"""The view layer: named SQL views, rendered for Spark and, as the correctness oracle, for DuckDB."""
