"""Scalar expressions as SQL, for use in views and in spark.sql()."""
