"""DataFrame-in, DataFrame-out operators on planning tables."""
