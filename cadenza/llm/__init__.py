"""Operators for building training corpora; see queries.py for their registered queries."""
