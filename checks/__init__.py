"""DuckDB restatements of the registered queries."""
