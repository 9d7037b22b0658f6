"""What can go wrong, one class each."""


class VaultError(Exception):
    """Any error of a vault."""


class InvalidName(VaultError):
    """A logical name breaks a rule."""


class NotFound(VaultError):
    """No such file, version or snapshot."""


class AlreadyExists(VaultError):
    """A snapshot's label is taken."""


class Corrupt(VaultError):
    """Stored bytes or references do not fit."""


class Conflict(VaultError):
    """Another writer took the log number."""


class AuthenticationError(VaultError):
    """A wrong passphrase."""


class PasswordRequired(VaultError):
    """An encrypted store was opened without a passphrase."""


class WeakPassphrase(VaultError):
    """A passphrase is too short or blank."""


class NotEncrypted(VaultError):
    """A passphrase was given for a plain store."""


class WouldBlock(VaultError):
    """A file kept changing while it was read."""
