"""Statements: text to tokens, tokens to trees, trees to DataFrames."""
