"""DDL, type hints and the rewriting of SQL with paths."""
