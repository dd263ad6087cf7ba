"""Registered queries: each pairs a Spark job with an independent SQL oracle."""
