"""Readers of feeds and files."""
