"""Gevel: social real-estate analytics on Apache Spark."""
