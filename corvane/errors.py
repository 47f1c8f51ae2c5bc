"""What can go wrong, by name."""


class CorvaneError(Exception):
    """Base of all others."""


class EmptyIndexError(CorvaneError, RuntimeError):
    """A search over an index without rows."""


class IndexStoreError(CorvaneError):
    """An index cannot be saved or loaded."""


class UnsupportedFormatError(CorvaneError, ValueError):
    """Documents of formats that no renderer takes."""


class BackendUnavailableError(CorvaneError):
    """A model or renderer that is not installed."""


class CorpusError(CorvaneError, ValueError):
    """A corpus line that cannot be read."""


class ConfigurationError(CorvaneError, ValueError):
    """Settings that are out of range or do not go together."""


class EmbeddingError(CorvaneError):
    """A text or an image that cannot be embedded."""


class RenderingError(CorvaneError):
    """A document that cannot be made into page images."""


class EmptyQueryError(CorvaneError, ValueError):
    """A search for nothing but white space."""


class DependencyError(CorvaneError, RuntimeError):
    """A model or store that is called failed; kind is unavailable or timeout."""

    def __init__(self, message: str, kind: str = "unavailable"):
        if kind not in ("unavailable", "timeout"):
            raise ValueError("kind is unavailable or timeout")
        super().__init__(message, kind)
        self.kind = kind

    def __str__(self) -> str:
        return f"{self.kind}: {self.args[0]}"
