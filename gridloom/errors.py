"""What can be wrong with a matrix."""

from __future__ import annotations


class MatrixError(ValueError):
    """Any misuse of a matrix."""


class BadDimensions(MatrixError):
    """Shapes that an operation cannot take."""


class IncompatibleShapes(BadDimensions):
    """Two matrices whose shapes do not go together."""


class NotSquare(BadDimensions):
    """A square matrix is needed."""


class NotVector(BadDimensions):
    """A row or column is needed."""


class OutOfBounds(MatrixError, IndexError):
    """A row, column or window outside the matrix."""


class SingularMatrix(MatrixError):
    """A matrix without an inverse."""


class NoSharedFolder(RuntimeError):
    """A cluster that names no folder for tables which outlive a lost executor."""


class TooLarge(MatrixError):
    """A matrix that does not fit on the driver."""
