"""Operators for training-data pipelines over text, vectors and conversations.

Each module holds one operator with a general interface; ``queries`` registers
them with production parameters. Nothing else in the library imports this package.
"""
