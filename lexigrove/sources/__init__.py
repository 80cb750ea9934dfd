"""Reading documents, exporting results, and tables with versions and snapshots."""
