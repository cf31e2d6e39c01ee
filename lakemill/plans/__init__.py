"""Facts, dimensions, marts and the queries over them."""
