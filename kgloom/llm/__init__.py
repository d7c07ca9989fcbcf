"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator with its own general
interface; ``queries`` binds the operators to the tables of a folder.
"""
