"""Drawing-review analytics as Spark DataFrame operators."""
