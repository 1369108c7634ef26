"""A shape-from-focus measurement engine on Spark."""
