"""Relational operators over listings, users, searches and notifications; DataFrames in, DataFrames out."""
