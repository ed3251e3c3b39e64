"""Readers for landed files and writers for result tables."""
