"""Readers of captured data."""
