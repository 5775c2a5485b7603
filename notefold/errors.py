"""What can stop a run, each with the exit status of the command line."""

from __future__ import annotations


class NotefoldError(Exception):
    exit_code = 1


class UsageError(NotefoldError):
    exit_code = 2


class IndexInsideSource(UsageError):
    """The index would lie inside the notes or the notes inside the index."""


class NotSynced(NotefoldError):
    exit_code = 5


class NewerIndex(NotefoldError):
    """The index was made by a newer version; it is refused, never guessed."""

    exit_code = 5


class SourceMissing(NotefoldError):
    exit_code = 5


class SourceEmpty(NotefoldError):
    """No note where there were some: a safety stop."""

    exit_code = 4


class MassDelete(NotefoldError):
    """Many notes at once would leave the index: a safety stop."""

    exit_code = 4


class StillDownloading(NotefoldError):
    exit_code = 5


class Busy(NotefoldError):
    """Another run published first."""

    exit_code = 6


class EmbeddingFails(NotefoldError):
    """So many notes got no vector that going on makes no sense."""
