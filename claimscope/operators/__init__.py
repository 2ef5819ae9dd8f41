"""Operators: DataFrame -> DataFrame jobs over the claims table."""
