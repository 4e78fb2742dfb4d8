"""Registered queries, their inputs and their reference SQL."""
