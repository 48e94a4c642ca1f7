"""Registered queries and the DuckDB SQL that states the same results."""
