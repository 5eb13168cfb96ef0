"""searchpulse: search-log analytics as composable PySpark DataFrame functions."""

from searchpulse.config import TrendConfig
from searchpulse.session import build_session, work_dir

__all__ = ["TrendConfig", "build_session", "work_dir"]
