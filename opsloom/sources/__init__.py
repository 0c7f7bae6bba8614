"""Readers of semi-structured files and writers of results. A reader takes a table of (doc, text) or lines,
so the same plan serves files, tables and streams; helpers read files into that shape."""
