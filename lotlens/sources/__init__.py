"""Schemas, constant relations and readers."""
