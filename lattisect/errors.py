"""What can be wrong with a request or a grid."""


class CubeError(Exception):
    """Base of all errors of this library."""


class BadRequest(CubeError):
    """A request that selects from nothing: a source without axes, or an unknown option."""


class AxisOverdefined(CubeError):
    def __init__(self, axis: str) -> None:
        super().__init__(f"axis {axis} is in two shapes of the request; use a union")
        self.axis = axis


class AxisUnderdefined(CubeError):
    def __init__(self, axis: str) -> None:
        super().__init__(f"no shape of the request has axis {axis}")
        self.axis = axis


class AxisNotFound(CubeError):
    def __init__(self, axis: str) -> None:
        super().__init__(f"the cube has no axis {axis}")
        self.axis = axis


class Unsliceable(CubeError):
    def __init__(self, axis: str) -> None:
        super().__init__(f"axis {axis} is categorical: only a selection of values fits it")
        self.axis = axis


class BadGrid(CubeError):
    """A grid whose parameters or hash don't hold."""


class MissingValue(ValueError, CubeError):
    """A value that a categorical axis doesn't have."""
