"""Event logs: adapters, readers and writers."""
