"""Readers and writers of the question, answer and stage tables."""
