"""Document-corpus search and analytics expressed as Spark DataFrame operators."""
