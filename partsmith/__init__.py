"""partsmith: material-master cleaning as PySpark DataFrame jobs."""

from partsmith.config import Settings
from partsmith.session import build_session, tune

__all__ = ["Settings", "build_session", "tune"]
