"""Procurement-compliance and training-data analytics as Spark DataFrame operators."""
