"""Landed payloads to posting records, and report sinks."""
