"""gridmill: tabular profiling, KPI, charting and modelling jobs for Spark."""

__version__ = "0.1.0"
