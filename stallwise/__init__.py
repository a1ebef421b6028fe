"""Marketplace price intelligence as Spark DataFrame jobs."""
