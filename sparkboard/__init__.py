"""Self-service analytics on tables, written with the public DataFrame and SQL API.

Every public function takes DataFrames and returns DataFrames; Spark decides how to run them.
"""
