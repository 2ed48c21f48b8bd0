"""Structured Streaming: latest wins, lifetimes, reactive aggregates."""
