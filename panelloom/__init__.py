"""Panel forecasting analytics on Spark: reshape, features, backtests, metrics, calibration."""
