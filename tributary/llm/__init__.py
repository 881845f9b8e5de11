"""Training-data operators: filtering, deduplication, extraction, scoring and mixing.

Every operator takes a DataFrame and column names, reads only the columns it is told to read, and
returns its own columns, so extra columns in the input never clash with its working columns.
"""
