"""Simulated reads and populations."""
