"""Compilation of schema sets on the driver: drafts, declarations, catalog, graph."""
