"""Operators over changelog DataFrames."""
