"""Scans of exports, listings and content, and the sinks next to them."""
