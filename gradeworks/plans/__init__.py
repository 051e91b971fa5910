"""Registered queries, their table bindings and SQL twins."""
