"""Retail analytics and corpus preparation as Spark DataFrame functions."""
