"""Monitoring operators for batch tables and Structured Streaming."""
