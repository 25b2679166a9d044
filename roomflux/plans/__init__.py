"""Plan helpers: lineage cuts and fix-point loops."""
