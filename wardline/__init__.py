"""Spark-native detection of suspicious event sequences and reporting on the alerts they raise."""
