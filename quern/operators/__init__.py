"""Relational, statistical and data-quality operators."""
