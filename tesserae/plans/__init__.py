"""Physical-plan helpers: lineage cuts, size-checked joins, sessions."""
