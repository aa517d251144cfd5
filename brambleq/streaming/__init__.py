"""Structured Streaming: watching a tree, sessions of changes."""
