"""Forecasting and drift monitoring of many time series as PySpark DataFrame operators."""
