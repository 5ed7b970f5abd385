"""DataFrame operators: filters, joins, groupings and selections."""
