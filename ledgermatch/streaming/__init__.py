"""Streaming use of the stateless operators.

The reference has no streaming operators (one finite upload per run). The
field extraction (sections, fields) and the statement-line parser are pure
column expressions and ``split``/``explode``; they run unchanged on a
streaming DataFrame. Matching is a batch operation over a settled set of
invoices and transactions and is not offered as a stream.
"""

from .extract_stream import extract_invoice_stream, start_invoice_stream

__all__ = ["extract_invoice_stream", "start_invoice_stream"]
