"""DataFrame operators: joins, aggregations and ordering over whole tables."""
