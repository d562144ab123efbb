"""DataFrame -> DataFrame steps: rollups, baselines, labels, search, evaluation, statistics, classifier."""
