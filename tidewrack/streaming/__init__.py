"""Structured Streaming over the engine's logs and landed pages."""
