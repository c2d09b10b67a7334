"""Audit trails of machine-learning decisions as Spark jobs over whole populations."""
