"""Streams: an extension. The model has a polled queue only; here its states arrive as events."""
