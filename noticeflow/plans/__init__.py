"""Named queries, each composed of the operators."""
