"""Readers, writers and model providers."""
