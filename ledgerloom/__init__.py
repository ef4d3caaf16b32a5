"""ledgerloom: document-table analytics on Spark DataFrames."""
