"""Readers and writers of partitioned tables and of per-event CSV files."""
