"""The same figures from streams of strokes."""
