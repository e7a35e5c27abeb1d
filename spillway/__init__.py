"""An engine on PySpark that orders, merges and verifies data sets larger than memory."""
