"""Reconciliation and forecasting of overlapping sensor series on Spark."""
