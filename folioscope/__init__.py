"""Page-level retrieval evaluation as lazy Spark plans.

Core modules never import :mod:`folioscope.llm`; that subpackage holds the
operators for training data and may be removed without touching the rest.
"""

from folioscope.errors import FolioscopeError

__all__ = ["FolioscopeError"]
