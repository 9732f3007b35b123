"""ledgermatch: bulk invoice-to-payment reconciliation on Spark DataFrames.

Every public function takes and returns DataFrames or Columns, so that many
invoices and many bank statements are reconciled in one Spark plan.
"""

__version__ = "0.1.0"
