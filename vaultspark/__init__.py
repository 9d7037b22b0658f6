"""vaultspark: a versioned, content-addressed, deduplicating vault as Spark plans."""

__version__ = "0.1.0"
