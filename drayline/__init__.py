"""Table movement, incremental sync and reconciliation as Spark jobs."""
