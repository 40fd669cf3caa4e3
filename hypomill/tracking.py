"""Driver-side artifacts and provenance: content-addressed bytes, run manifests, assumptions."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import re
import subprocess
import tempfile
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypomill.errors import ConfigError, ManifestError, StoreError
from hypomill.functions.jsoncanon import canonical_json, config_sha256, run_id
from hypomill.schemas import EVIDENCE_LABELS


def file_sha256(path: Path | str) -> str:
    """Hash of a file of any size, in pieces."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@dataclass(frozen=True)
class Artifact:
    sha256: str
    path: Path
    count: int


def _place(source: Path, target: Path) -> None:
    """Move finished bytes to their final name; equal bytes that are there already win, others are an error."""
    target.parent.mkdir(parents=True, exist_ok=True)
    try:
        os.link(source, target)
    except FileExistsError:
        if file_sha256(target) != file_sha256(source):
            raise StoreError(f"{target} holds other bytes") from None
    finally:
        source.unlink(missing_ok=True)


class ContentStore:
    """Bytes kept once, under their SHA-256."""

    def __init__(self, root: Path | str) -> None:
        self.root = Path(root)

    def put(self, payload: bytes, suffix: str = "") -> Artifact:
        if not isinstance(payload, bytes):
            raise StoreError("only bytes can be stored")
        if suffix and not re.fullmatch(r"\.[a-z0-9]+", suffix):
            raise StoreError("suffix must be a dot and lower-case letters or digits")
        digest = hashlib.sha256(payload).hexdigest()
        target = self.root / digest[:2] / f"{digest}{suffix}"
        _place(_temporary(target.parent, [payload])[0], target)
        return Artifact(digest, target, len(payload))


def _temporary(folder: Path, chunks: Iterable[bytes]) -> tuple[Path, str]:
    """Chunks written and synced to a temporary file; its path and hash."""
    folder.mkdir(parents=True, exist_ok=True)
    digest = hashlib.sha256()
    with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
        for chunk in chunks:
            digest.update(chunk)
            f.write(chunk)
        f.flush()
        os.fsync(f.fileno())
    return Path(f.name), digest.hexdigest()


def canonical_lines(rows: DataFrame, key: str, volatile: tuple[str, ...] = ()) -> Iterator[bytes]:
    """Canonical JSONL of rows, sorted by key, streamed partition by partition.

    Fields named in ``volatile`` (host, time of creation) are written as null, so equal
    content has equal bytes.
    """
    def clean(value: Any) -> Any:
        if isinstance(value, dict):
            return {k: None if k in volatile else clean(v) for k, v in value.items()}
        return [clean(v) for v in value] if isinstance(value, list) else value

    for row in rows.orderBy(key).toLocalIterator():
        yield (canonical_json(clean(row.asDict(recursive=True))) + "\n").encode()


def write_jsonl_once(rows: DataFrame, root: Path | str, folders: Iterable[str], key: str = "utt_id", volatile: tuple[str, ...] = ()) -> Artifact:
    """Publish rows at ``<root>/<folders>/<sha256>/records.jsonl``.

    Writing equal content again changes nothing; keys must be unique and there must be a row.
    """
    total, unique = rows.selectExpr("count(*)", f"count(distinct {key})").first()
    if not total:
        raise ManifestError("nothing to publish")
    if unique != total:
        raise ManifestError(f"{key} is not unique")
    base = Path(root).joinpath(*folders)
    temporary, digest = _temporary(base, canonical_lines(rows, key, volatile))
    target = base / digest / "records.jsonl"
    _place(temporary, target)
    return Artifact(digest, target, total)


def write_manifest_once(rows: DataFrame, root: Path | str) -> Artifact:
    """Publish one dataset's one split."""
    kinds = rows.select("dataset", "split").distinct().take(2)
    audio = rows.groupBy("audio_path").count().where("count > 1").take(1)
    if len(kinds) != 1:
        raise ManifestError("a manifest holds exactly one dataset and split")
    if audio:
        raise ManifestError("an audio path is not unique")
    return write_jsonl_once(rows, root, [kinds[0].dataset, kinds[0].split])


VOLATILE = ("created_utc", "host")


def write_nbest_once(records: DataFrame, root: Path | str, system: str) -> Artifact:
    """Publish N-best records under a hash of their content alone."""
    return write_jsonl_once(records, root, [system], volatile=VOLATILE)


def write_outputs_once(outputs: DataFrame, root: Path | str, system: str) -> Artifact:
    """Publish one correction system's outputs, one per utterance."""
    if outputs.select("ec_system_id").distinct().where(F.col("ec_system_id") != system).take(1):
        raise ManifestError(f"outputs of another system than {system}")
    return write_jsonl_once(outputs, root, [system])


def write_exchanges_once(exchanges: DataFrame, root: Path | str, model: str) -> Artifact:
    """Publish one model's exchanges under their request hashes; times of asking are no content."""
    return write_jsonl_once(exchanges, root, [model], key="request_hash", volatile=("requested_utc", "response_utc", "latency_ms"))


def write_pairs_once(pairs: DataFrame, root: Path | str, name: str) -> Artifact:
    return write_jsonl_once(pairs, root, [name])


@dataclass(frozen=True)
class RunManifest:
    run_id: str
    config_sha256: str
    command: tuple[str, ...]
    created_utc: str
    python_version: str
    platform: str
    git_commit: str | None
    git_dirty: bool | None
    dependency_lock_sha256: str | None
    input_artifact_hashes: Mapping[str, str] = field(default_factory=dict)
    output_artifact_hashes: Mapping[str, str] = field(default_factory=dict)


def write_json(path: Path, value: Any) -> None:
    path.write_text(json.dumps(value, ensure_ascii=True, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def start_run(root: Path | str, prefix: str, config: Mapping[str, Any], command: tuple[str, ...], inputs: Mapping[str, str] | None = None, retry: bool = True) -> tuple[Path, RunManifest]:
    """A new run folder with its manifest and configuration; made before the work, so failed runs stay visible.

    A folder that is there is never reused: with ``retry`` the next free ``-attempt-NN`` is taken.
    """
    if not command:
        raise ConfigError("command must not be empty")
    name = run_id(prefix, config)
    for attempt in range(100 if retry else 1):
        folder = Path(root) / (f"{name}-attempt-{attempt:02d}" if attempt else name)
        try:
            folder.mkdir(parents=True)
            break
        except FileExistsError:
            continue
    else:
        raise StoreError(f"run exists: {name}")
    lock = Path("uv.lock")
    manifest = RunManifest(
        folder.name, config_sha256(config), tuple(command), datetime.now(UTC).isoformat(), platform.python_version(), platform.platform(),
        *_git_state(), file_sha256(lock) if lock.is_file() else None, dict(inputs or {}))
    write_json(folder / "run_manifest.json", asdict(manifest))
    write_json(folder / "resolved_config.json", json.loads(canonical_json(config)))
    return folder, manifest


def finish_run(folder: Path, manifest: RunManifest, outputs: Mapping[str, str]) -> None:
    """Record what a run made."""
    write_json(folder / "output_artifacts.json", dict(outputs))
    write_json(folder / "run_manifest.json", asdict(manifest) | {"output_artifact_hashes": dict(outputs)})


def _git_state() -> tuple[str | None, bool | None]:
    def git(*args: str) -> str:
        return subprocess.run(["git", *args], check=True, capture_output=True, text=True).stdout.strip()

    try:
        return git("rev-parse", "HEAD"), bool(git("status", "--porcelain"))
    except (OSError, subprocess.CalledProcessError):
        return None, None


class Assumptions:
    """Labelled choices of a run, written once."""

    def __init__(self) -> None:
        self.items: dict[str, dict[str, Any]] = {}

    def add(self, assumption_id: str, choice: str, reason: str, evidence_label: str, alternatives_tested: tuple[str, ...] = (), selected_on: str | None = None) -> None:
        if not (assumption_id.strip() and choice.strip() and reason.strip()):
            raise ConfigError("id, choice and reason must not be blank")
        if evidence_label not in EVIDENCE_LABELS:
            raise ConfigError(f"unknown evidence label: {evidence_label}")
        if assumption_id in self.items:
            raise ConfigError(f"assumption is there already: {assumption_id}")
        self.items[assumption_id] = {
            "assumption_id": assumption_id, "choice": choice, "reason": reason, "evidence_label": evidence_label,
            "alternatives_tested": list(alternatives_tested), "selected_on": selected_on}

    def write_once(self, path: Path) -> None:
        if path.exists():
            raise StoreError(f"{path} exists")
        path.parent.mkdir(parents=True, exist_ok=True)
        write_json(path, list(self.items.values()))
