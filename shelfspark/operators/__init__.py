"""DataFrame operators: filters, joins, ranking, vector joins, upserts."""
