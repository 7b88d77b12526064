"""Containers and tables."""
