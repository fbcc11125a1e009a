"""DataFrame to DataFrame operators: sampling, profiling, series, scans, repair, text."""
