"""graphloom: branch-aware property-graph analytics on PySpark DataFrames."""
