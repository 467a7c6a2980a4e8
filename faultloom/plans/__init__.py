"""Whole jobs composed of operators, and the catalog of registered queries."""
