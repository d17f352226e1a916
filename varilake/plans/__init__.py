"""Text layouts of other programs' input files, as DataFrames of ordered lines."""
