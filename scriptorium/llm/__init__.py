"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` holds the thin registered queries built from them.
"""
