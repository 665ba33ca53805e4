"""Whole evaluations composed from operators, and the derived test tables."""
