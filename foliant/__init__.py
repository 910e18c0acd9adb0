"""A Spark-first engine for document structuring and artifact analytics."""
