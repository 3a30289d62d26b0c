"""tidewell: data exploration and declarative flows as Spark DataFrame plans."""

from tidewell.frame import Frame, Meta, UnknownColumnError
from tidewell.session import build_session, prepare

__all__ = ["Frame", "Meta", "UnknownColumnError", "build_session", "prepare"]
