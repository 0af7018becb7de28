"""Document-analytics operators for Apache Spark: retrieval, verification, document structure, evaluation."""
