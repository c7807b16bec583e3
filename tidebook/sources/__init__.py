"""Readers, parsers, sinks and the tick view derived from events."""
