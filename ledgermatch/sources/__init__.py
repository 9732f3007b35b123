"""Inputs: document text, delimited statements, statement lines, routing."""
