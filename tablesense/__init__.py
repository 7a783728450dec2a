"""tablesense: Spark jobs that clean, profile, relate, publish and query messy tables.

Every function takes DataFrames and returns DataFrames.  Only *metadata* (column
names, one row of counts per column) ever reaches the driver.
"""
