"""Readers, writers, seeds and the fault generator."""
