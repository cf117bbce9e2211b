"""strandframe: comparative sequence analytics as Spark DataFrame operators."""
