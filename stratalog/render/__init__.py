"""Sinks and presentation: small collected results as JSON, Markdown, TSV, HTML and SVG."""
