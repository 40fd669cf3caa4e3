"""One family of errors for driver-side checks."""


class HypomillError(ValueError):
    """Base of every error this library raises."""


class ContractError(HypomillError):
    """A record breaks its contract."""


class ManifestError(HypomillError):
    """A manifest or artifact cannot be published."""


class MetricError(HypomillError):
    """A metric has no value for its input."""


class DecodingError(HypomillError):
    """Scores and candidates do not fit together."""


class ConfigError(HypomillError):
    """A configuration is incomplete or has no canonical form."""


class StoreError(HypomillError):
    """Immutable bytes would change."""
