"""Order-warehouse and stream-analytics toolkit on PySpark."""
