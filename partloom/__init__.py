"""Bill-of-materials analytics as Spark DataFrame plans."""
