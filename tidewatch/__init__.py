"""Panel monitoring and time-series diagnostics as Spark DataFrame operators."""

from tidewatch.config import MonitorConfig

__all__ = ["MonitorConfig"]
