"""Training-data operators. Nothing else in the library imports this package.

Every operator is a plain function over DataFrames; ``queries.py`` holds the registered queries and their SQL.
"""
