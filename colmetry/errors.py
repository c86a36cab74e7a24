"""Errors a caller may want to tell apart."""


class ProfileError(Exception):
    """A profile could not be planned, computed or trusted."""


class StorageError(ProfileError):
    """Stored results are missing, incomplete or of an unknown version."""


class NotFoundError(ProfileError):
    """No stored relation matches the identifier."""


class AmbiguousError(ProfileError):
    """Several relations match the identifier."""
