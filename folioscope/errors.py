"""One exception hierarchy for the whole engine."""


class FolioscopeError(Exception):
    """Base of every error raised on purpose by this package."""


class CollectionError(FolioscopeError):
    """A collection file or its content breaks a rule."""


class ParsingError(FolioscopeError):
    """A parser, its options or its output is not usable."""


class ChunkingError(FolioscopeError):
    """A chunking strategy, its options or a span is not usable."""


class IndexingError(FolioscopeError):
    """An encoder, embedding or index artifact is not usable."""


class RetrievalError(FolioscopeError):
    """A query set, score or retrieval artifact is not usable."""


class EvaluationError(FolioscopeError):
    """A run, judgment set, metric or cutoff is not usable."""


class ArtifactError(FolioscopeError):
    """A stored stage result is missing, partial or of another configuration."""


class ExperimentError(FolioscopeError):
    """A stage of an experiment failed."""


class BenchmarkError(FolioscopeError):
    """A benchmark is ill-formed or one of its experiments failed."""
