"""Readers and writers for dumps, tables and parameter files."""
