"""arledger: accounts-receivable snapshot analytics as plain PySpark DataFrame operations."""
