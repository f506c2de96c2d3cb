"""Document-card extraction and corpus preparation as lazy Spark operators."""
