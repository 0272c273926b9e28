"""Operators of the triage engine."""
