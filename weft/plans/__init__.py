"""Named queries over the driver tables, with their DuckDB statements."""
