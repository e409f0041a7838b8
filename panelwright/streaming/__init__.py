"""Structured Streaming forms of the bar, late-event, expiry and recursion rules."""
