"""Exceptions of the library."""


class DatasetError(Exception):
    """A dataset can't do what is asked of it."""


class DatasetFinalizedError(DatasetError):
    """A finalized dataset was asked to change."""


class DatasetNotFinalizedError(DatasetError):
    """A dataset must be finalized before it is saved."""


class NetworkNotFinalizedError(Exception):
    """A Bayesian network must be finalized before it is queried."""


class LockedPathError(Exception):
    """A locked folder was asked to change."""


class ExperimentLockedError(LockedPathError):
    """An experiment whose folder is locked doesn't run again."""


class InsufficientSamples(Exception):
    """A test of conditional independence has too few samples for its degrees of freedom."""

    def __init__(self, result):
        super().__init__(f"insufficient samples for {result}")
        self.result = result


class UnequalCounts(ValueError):
    """Variables to be joined have different numbers of instances."""
