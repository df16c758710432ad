"""Operators over the relations of page-structured documents."""
