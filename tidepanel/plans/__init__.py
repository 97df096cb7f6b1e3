"""Whole stages, chained from the operators."""
