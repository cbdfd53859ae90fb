"""The test fixture as DataFrames and SQL, and the query catalogue."""
