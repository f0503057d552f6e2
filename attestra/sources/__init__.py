"""Readers from downloaded files to evidence rows, and sinks.

Readers take a path (or a glob of files) and read it in parallel by file. ``ord`` numbers
rows by file and position, so arrival order is stable between runs.
"""
