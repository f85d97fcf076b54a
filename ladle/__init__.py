"""A Spark-first engine for semi-structured catalogue and text data."""
