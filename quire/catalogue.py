"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .queries import ORACLES, QUERIES, content, files, forms, functions, graph, images, layout, pages, references, search, text

__all__ = ["ORACLES", "QUERIES"]
_MODULES = (content, files, forms, functions, graph, images, layout, pages, references, search, text)
