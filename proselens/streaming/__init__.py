"""Structured Streaming forms: debounced analysis of edited documents."""
