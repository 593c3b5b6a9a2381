"""Text-to-graph analytics expressed as Spark DataFrame plans."""
