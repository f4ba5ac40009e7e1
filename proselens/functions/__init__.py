"""Part of the prose-quality engine."""
