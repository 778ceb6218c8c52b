"""Continuous forms of the batch operators over append-only event logs."""
