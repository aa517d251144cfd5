"""Readers: source trees, configuration, baselines, generated programs."""
