"""Composed jobs: the labelling plan, the whole-job command line, the query catalog and its oracle SQL."""
