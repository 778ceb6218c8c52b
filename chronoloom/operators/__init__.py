"""Relational operators: intervals, filters, joins, classification, aggregates, exploration."""
