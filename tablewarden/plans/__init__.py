"""What is built from checks, sources and functions."""
