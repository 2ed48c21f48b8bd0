"""Sinks: packages, page files, traces."""
