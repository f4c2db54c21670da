"""Operators that prepare web text for language-model training. Nothing else in the library imports this package."""
