"""Check inputs: claim snapshots derived from the given tables, and SQL that restates every
query independently."""
