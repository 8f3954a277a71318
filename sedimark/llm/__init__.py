"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it. ``queries`` holds the registered
queries; each operator has a module of its own with a general interface.
"""
