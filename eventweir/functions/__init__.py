"""Columns: the event schema, predicates on events, scalar functions."""
