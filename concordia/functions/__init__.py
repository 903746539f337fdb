"""Part of Concordia."""
