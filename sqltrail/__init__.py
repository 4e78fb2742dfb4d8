"""Spark engine that answers which database objects a body of source code reads or modifies."""
