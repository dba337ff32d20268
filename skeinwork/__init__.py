"""skeinwork: window-based time-series forecasting analytics on Spark DataFrames."""
