"""Operators that prepare text for training: one module an operator, queries in ``queries``."""
