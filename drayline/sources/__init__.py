"""Readers and writers: Parquet, JDBC, JSON rows, CSV, snapshot and keyed tables."""
