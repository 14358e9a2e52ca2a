"""Registered queries over the given tables, with DuckDB checks where SQL can say them."""
