"""Column builders: time windows and hour buckets, exact money sums, the alert rule and label."""
