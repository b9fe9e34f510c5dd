"""Incremental forms. Every one ends in the state its batch form computes."""
