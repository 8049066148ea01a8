"""Scalar functions: Column in, Column out, never a Python UDF. Null in gives null out unless said otherwise."""
