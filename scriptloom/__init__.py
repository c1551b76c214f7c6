"""Script breakdown and evidence ledger as PySpark DataFrame operators."""
