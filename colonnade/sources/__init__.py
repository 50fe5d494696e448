"""Stored tables, mounted tables, system tables."""
