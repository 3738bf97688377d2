"""Readers and writers of the store, event logs, dimension tables and file snapshots."""
