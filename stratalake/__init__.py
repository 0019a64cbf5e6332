"""Table operators for layered (bronze, silver, gold) data work on Spark.

Every operator takes and returns DataFrames and stays lazy; planning and
execution are left to Spark.
"""
