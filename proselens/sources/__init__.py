"""Sources and sinks: documents from tables, rejects on the side, answers as JSON."""
