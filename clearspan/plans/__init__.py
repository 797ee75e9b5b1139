"""Pipelines over several operators, and the registered queries."""
