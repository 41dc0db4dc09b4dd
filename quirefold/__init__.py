"""Document-ledger analytics as Spark DataFrame operations."""
