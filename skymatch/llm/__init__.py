"""Operators that prepare language-model training data; nothing outside this subpackage imports it."""
