"""Operators for preparing language-model training text at corpus scale.

Nothing outside this subpackage imports it.
"""
