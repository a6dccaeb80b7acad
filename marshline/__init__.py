"""Grid-cell habitat analytics on Spark DataFrames."""

from marshline.grid import GridSpec
from marshline.session import build_session, stage

__all__ = ["GridSpec", "build_session", "stage"]
