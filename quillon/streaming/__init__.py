"""Streams of new statements and commands."""
