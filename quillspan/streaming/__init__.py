"""Structured Streaming: an extension, as the studied pipeline is batch alone."""
