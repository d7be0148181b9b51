"""Jobs composed of the operators: training, forecasting, rain estimates."""
