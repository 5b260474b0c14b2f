"""Named queries over an event table, each with the same question in DuckDB SQL."""
