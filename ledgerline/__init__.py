"""API inventory and reconciliation analytics on Spark DataFrames."""
