"""Whole checks: the rules of record kinds, a tree of artifacts, and the registered queries."""
