"""Operators on event tables: conditions over time, contexts, joins, actions, reports."""
