"""Mapping documents to rules."""
