"""Structured Streaming forms of scoring, windowed metrics, alarms and the model life cycle."""
