"""Single-cell alignment analytics as Spark DataFrame operators."""
