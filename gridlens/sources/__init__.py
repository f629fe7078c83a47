"""Readers for landed feeds and stored tables."""
