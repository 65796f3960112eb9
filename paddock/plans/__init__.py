"""Queries: compositions of the operators over tables."""
