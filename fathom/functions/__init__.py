"""Columns and small functions: text analysis, stemming, string distance, geometry, vectors, scores."""
