"""lumenfreq: a Spark-native analytics engine for spectra of time series."""
