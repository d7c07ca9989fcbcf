"""Scalar functions: ``columns`` as built-in column expressions, ``matching`` and ``spans`` as Arrow UDFs."""
