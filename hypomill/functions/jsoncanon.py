"""Canonical JSON: sorted keys, no blanks, ASCII only, finite numbers."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping
from pathlib import PurePath
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hypomill.errors import ConfigError


class _Encoder(json.JSONEncoder):
    """The one encoder of canonical text; what JSON itself does not know comes to ``default``."""

    def __init__(self) -> None:
        super().__init__(ensure_ascii=True, allow_nan=False, sort_keys=True, separators=(",", ":"))

    def default(self, o: Any) -> Any:
        if isinstance(o, PurePath):
            return o.as_posix()
        return dict(o) if isinstance(o, Mapping) else super().default(o)


def _keys(value: Any) -> Iterator[Any]:
    """Every key of every mapping below ``value``."""
    if isinstance(value, Mapping):
        yield from value
    for inner in value.values() if isinstance(value, Mapping) else value if isinstance(value, list | tuple) else ():
        yield from _keys(inner)


def canonical_json(value: Any) -> str:
    """Text of a value; not finite numbers, keys that are no text and foreign types have none."""
    try:
        text = _Encoder().encode(value)
    except (TypeError, ValueError) as error:
        raise ConfigError(f"no canonical form: {error}") from error
    if not all(isinstance(k, str) for k in _keys(value)):
        raise ConfigError("no canonical form: a key is no text")
    return text


def config_sha256(config: Mapping[str, Any]) -> str:
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


#: A run's name: a readable prefix and 8 to 64 digits of the configuration's hash.
RUN_NAME = re.compile(r"[a-z0-9][a-z0-9-]*-[0-9a-f]{8,64}")


def run_id(prefix: str, config: Mapping[str, Any], digits: int = 12) -> str:
    name = f"{prefix}-{config_sha256(config)[:digits]}"
    if len(name) != len(prefix) + 1 + digits or not RUN_NAME.fullmatch(name):
        raise ConfigError(f"no name of a run: {name}")
    return name


@F.pandas_udf(T.StringType())
def canonical_json_text(text: pd.Series) -> pd.Series:
    """JSON text to its canonical form; null where it is no JSON or holds a non-finite number."""
    def one(s):
        try:
            return None if s is None else canonical_json(json.loads(s))
        except ValueError:
            return None

    return text.map(one)
