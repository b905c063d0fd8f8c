"""Stored tables and the views the registered queries read."""
