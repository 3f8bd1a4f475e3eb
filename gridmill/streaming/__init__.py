"""Continuous forms of the KPI, cleaning, flagging and scoring jobs."""
