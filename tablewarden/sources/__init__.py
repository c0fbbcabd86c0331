"""Readers and writers: registries, configurations, results, inspected tables."""
