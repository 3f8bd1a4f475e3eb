"""Preprocessing, estimators, evaluation, training and forecasting."""
