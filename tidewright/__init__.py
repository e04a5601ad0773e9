"""Spark-native current-state mirror: change folding, apply, versioned commits, reconciliation."""
