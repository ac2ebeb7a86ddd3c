"""Covariance analytics on panels of positive series, as Spark plans."""
