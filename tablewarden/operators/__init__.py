"""The checks: each counts violations, and most can also list them."""
