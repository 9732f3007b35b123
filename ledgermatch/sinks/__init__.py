"""Outputs: XML of invoices, CSV of matches, JSON of every table."""
