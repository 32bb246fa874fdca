"""Battery-fleet analytics as Spark DataFrame operators."""
