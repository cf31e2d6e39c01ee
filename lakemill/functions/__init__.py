"""Column helpers and lineage control."""
