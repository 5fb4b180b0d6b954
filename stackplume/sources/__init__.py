"""Scans, landed-payload parsers and sinks."""
