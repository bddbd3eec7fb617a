"""logrill: log analytics as Spark DataFrame operators."""
