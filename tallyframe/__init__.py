"""Column profiling, mapping and reconciliation as Spark jobs."""
