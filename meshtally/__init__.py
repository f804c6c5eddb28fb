"""Network-experiment log analytics as Spark DataFrame code."""
