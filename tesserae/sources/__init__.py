"""Readers, writers, feeds, calendars and inventories."""
