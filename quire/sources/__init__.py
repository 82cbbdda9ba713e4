"""Readers and writers: manuscripts, logs, settings, model providers."""
