"""Operators on DataFrames: joins, ordered folds, comparison, storage, layout."""
