"""Finding, scoring, masking and auditing personal and secret data with Spark."""
