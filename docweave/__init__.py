"""docweave: documentation-corpus retrieval and conversation analytics on Spark.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing here starts a session or collects a table.
"""
