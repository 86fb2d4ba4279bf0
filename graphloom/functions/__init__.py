"""Column expressions of the engine: all built from Spark functions, none a UDF."""
