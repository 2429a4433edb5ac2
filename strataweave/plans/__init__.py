"""Named queries over the operators, and the same in DuckDB SQL."""
