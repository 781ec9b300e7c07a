"""Sources of tables."""
