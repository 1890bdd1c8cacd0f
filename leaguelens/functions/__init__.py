"""The functions of the league engine; every function takes and returns DataFrames."""
