"""Readers, writers, quality checks and coverage of market tables."""
