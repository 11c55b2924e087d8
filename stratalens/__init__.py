"""stratalens: a Spark-first engine for exploring large tabular and hierarchical data."""
