"""The same decisions over streams."""
