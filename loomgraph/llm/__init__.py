"""Operators of the training-data pipeline that concern texts, source files and rankings."""
