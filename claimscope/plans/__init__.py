"""Plan-level building blocks shared by operators (distributed exact
quantiles, cross-partition running totals, one-row anchors) and the query
registry with its SQL twins."""
