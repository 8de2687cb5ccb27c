"""Whole runs, reports, and the registered queries."""
