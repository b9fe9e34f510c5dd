"""Compositions of operators: corpus, training set, triage, map; and the registered queries."""
