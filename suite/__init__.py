"""Registered queries: each has a Spark function and, where SQL can express it, an oracle."""
