"""DataFrame operators: filters, keyed updates, folds, deduplication, counts."""
