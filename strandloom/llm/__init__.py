"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  Every operator takes and returns DataFrames and
keeps extra input columns out of its way by selecting only what it names.
"""
