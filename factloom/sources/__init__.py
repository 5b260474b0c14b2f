"""Readers and writers: JSON bundles, the event-table adapter, and all-or-nothing table sets."""
