"""Profiles and simulator-ready tables."""
