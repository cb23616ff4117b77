"""Readers and writers of files and databases."""
