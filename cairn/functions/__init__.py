"""Scalar expressions: addressing, formatting and predicates."""
