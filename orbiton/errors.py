"""Errors of the engine."""


class VoronoiError(Exception):
    """Base of all errors that a computation raises."""


class InsufficientPoints(VoronoiError):
    def __init__(self, count: int):
        super().__init__(f"at least 4 points are needed, got {count}")
        self.count = count


class InvalidInput(VoronoiError):
    def __init__(self, point_index: int, message: str):
        super().__init__(f"point {point_index}: {message}")
        self.point_index = point_index


class InvalidConfiguration(VoronoiError):
    pass


class UnsupportedGeometry(VoronoiError):
    def __init__(self, generator_index: int, message: str):
        super().__init__(f"generator {generator_index}: {message}")
        self.generator_index = generator_index


class DegenerateInput(VoronoiError):
    def __init__(self, coincident_pairs: int, message: str):
        super().__init__(message)
        self.coincident_pairs = coincident_pairs


class RepresentationLimit(VoronoiError):
    pass


class CellEliminationRequired(VoronoiError):
    def __init__(self, generator_indices: list[int], remaining_exact_zero_edges: int):
        super().__init__(f"cells of generators {generator_indices} can't be represented")
        self.generator_indices = generator_indices
        self.remaining_exact_zero_edges = remaining_exact_zero_edges


class ComputationFailed(VoronoiError):
    pass


class SpherePointError(VoronoiError):
    """A direction that is not finite, zero, or off the unit sphere."""


class SphereQueryError(SpherePointError):
    """A query direction that is not finite or zero."""


class IndexedSphereQueryError(SphereQueryError):
    def __init__(self, query_index: int):
        super().__init__(f"query {query_index} is not finite or zero")
        self.query_index = query_index


class SphereEmbeddingError(VoronoiError):
    pass


class SphereProjectionError(VoronoiError):
    """A world point that is not finite or lies at the centre."""


class IndexedSphereProjectionError(SphereProjectionError):
    def __init__(self, point_index: int):
        super().__init__(f"world point {point_index} can't be projected")
        self.point_index = point_index


class CellElisionError(VoronoiError):
    """kind: `unrepresentable`, `residuals` or `invalid mesh`."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind
