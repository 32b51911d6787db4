"""Operators for preparing text collections for training, one module per problem.

Nothing outside this subpackage imports it.
"""
