"""almanac: places, their websites, page text and labels as Spark DataFrames.

Every operator is a plain function from DataFrame (or Column) to DataFrame (or
Column).  Column names are parameters; nothing here knows one subject matter.
"""
