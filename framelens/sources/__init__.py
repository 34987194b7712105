"""Readers, writers and the adapters that turn stored tables into frame series."""
