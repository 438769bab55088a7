"""Reusable DataFrame operators; nothing here knows table names."""
