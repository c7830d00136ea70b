"""sedgewire: code-knowledge analytics expressed as Spark DataFrame plans."""
