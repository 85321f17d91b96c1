"""Structured Streaming: online forecasts, event-time bars and monitoring alerts."""
