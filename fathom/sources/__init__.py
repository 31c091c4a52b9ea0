"""Readers, views, synonym collections, sinks and cursors."""
