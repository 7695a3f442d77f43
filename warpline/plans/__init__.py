"""Plan helpers: shared-folder tables and driver loops."""
