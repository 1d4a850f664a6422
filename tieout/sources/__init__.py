"""Readers of tables, uploads and text."""
