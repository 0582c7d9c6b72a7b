"""Readers of feeds, pages and snapshots, and the sinks that keep them."""
