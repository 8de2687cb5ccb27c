"""Landed inputs, state tables and sinks."""
