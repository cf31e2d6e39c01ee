"""General DataFrame operators: history, joins, ranking, spines and data quality."""
