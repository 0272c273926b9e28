"""Streaming of the triage engine."""
