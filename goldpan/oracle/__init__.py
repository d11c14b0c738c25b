"""DuckDB SQL that computes every statement a second, independent way."""
