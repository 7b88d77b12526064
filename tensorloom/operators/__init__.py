"""Relational operators on tensors."""
