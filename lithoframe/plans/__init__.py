"""Registered queries, grouped by domain, and the DuckDB SQL that each is checked against."""
