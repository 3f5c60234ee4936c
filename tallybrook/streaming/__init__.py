"""Structured Streaming over the event log: an extension, as the case records themselves come in batches."""
