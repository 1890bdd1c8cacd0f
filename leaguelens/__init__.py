"""League analytics and table-to-table operators on PySpark DataFrames."""
