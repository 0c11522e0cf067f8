"""Legislative analytics as Spark DataFrame operators."""
