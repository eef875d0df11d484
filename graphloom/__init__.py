"""Code-graph analytics expressed as DataFrame and SQL transformations."""
