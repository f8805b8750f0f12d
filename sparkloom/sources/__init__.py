"""Sources of model tables: text lines, source trees, configuration."""
