"""Operators for preparing training corpora, and their registered queries."""
