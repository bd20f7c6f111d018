"""Set-at-a-time document retrieval and analytics on PySpark."""
