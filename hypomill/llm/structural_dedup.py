"""Problem 5: records that differ only in formatting collapse to one, with their number of copies.

Merkle-style hashing of the parsed record, from the leaves up, to any depth: a leaf is
normalised and hashed, an object hashes the *sorted* digests of its named children (field
order is irrelevant), an array hashes its elements in order, or sorted where its order does
not count. Records with one root digest form a group; inside it the whole normalised
structure is compared, so a collision merges nothing. Rows meet their group by the digest
alone: texts cross the network once, combined by task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from hashlib import blake2b
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypomill.runtime import materialize

Leaf = Callable[[Any], Any]
_formatting = re.compile(r"[\W_]+")


def letters_and_digits(value: Any) -> Any:
    """A text's lower-cased letters and digits in order; other scalars as they are."""
    return _formatting.sub("", value.lower()) if isinstance(value, str) else value


def exact(value: Any) -> Any:
    return value


def number(value: Any) -> Any:
    """A number, also one written as text."""
    try:
        return value if isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return value


@dataclass(frozen=True)
class Rules:
    """How a record is read: the top fields that make its identity (all where None), the leaf rule of
    fields that are not free text, and the fields whose arrays have no order."""

    identity: tuple[str, ...] | None = None
    leaves: Mapping[str, Leaf] = field(default_factory=dict)
    unordered: frozenset[str] = frozenset()
    default: Leaf = letters_and_digits


def _leaf(value: Any, rule: Leaf) -> str:
    kept = rule(value)
    if kept is None:
        return "~"
    if isinstance(kept, bool):
        return "t" if kept else "f"
    if isinstance(kept, (int, float)):
        return f"n{float(kept)!r}" if abs(kept) < 2**53 else f"n{kept!r}"
    kept = str(kept)
    return f"s{len(kept)}:{kept}"


def _digest(payload: bytes) -> bytes:
    return blake2b(payload, digest_size=16).digest()


def merkle(value: Any, rules: Rules, name: str = "", top: bool = False) -> tuple[bytes, str]:
    """(digest, normalised structure) of a value: equal structures have equal digests, whatever their formatting."""
    if isinstance(value, dict):
        names = sorted(value) if not top or rules.identity is None else sorted(rules.identity)
        below = [(n, *merkle(value.get(n), rules, n)) for n in names]
        digests = sorted(_digest(n.encode("utf-8", "backslashreplace") + b"\0" + d) for n, d, _ in below)
        return _digest(b"{" + b"".join(digests)), "{" + ",".join(f"{len(n)}:{n}={s}" for n, _, s in below) + "}"
    if isinstance(value, list):
        below = [merkle(x, rules, name) for x in value]
        if name in rules.unordered:
            below.sort()
        return _digest(b"[" + b"".join(d for d, _ in below)), "[" + ",".join(s for _, s in below) + "]"
    text = _leaf(value, rules.leaves.get(name, rules.default))
    return _digest(text.encode("utf-8", "backslashreplace")), text


def with_root_digest(df: DataFrame, id_col: str, json_col: str, rules: Rules) -> DataFrame:
    """(id, root_digest, canonical) of every row whose JSON text is an object that states something.

    Text that is no JSON object (or one nested beyond the interpreter's stack, about a
    thousand levels), and an object without any field of the identity (or with
    nulls only), has no row. Of a field named twice the last one counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows: tuple[list, list, list] = ([], [], [])
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    try:
                        value = json.loads(text)
                        if not isinstance(value, dict) or all(value.get(n) is None for n in rules.identity or value):
                            continue
                        digest, canonical = merkle(value, rules, top=True)
                    except (ValueError, RecursionError):
                        continue
                    for column, v in zip(rows, (key, digest, canonical.encode("utf-8", "backslashreplace"))):
                        column.append(v)
                yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary()).cast(pa.string())], names=["id", "root_digest", "canonical"])

    light = df.where(F.col(json_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), json_col)
    return light.mapInArrow(run, "id long, root_digest binary, canonical string")


def group_copies(hashed: DataFrame) -> DataFrame:
    """(root_digest, canonical, first_id, copies): one row per distinct record.

    Counts are combined before the shuffle, so a group holding a third of all rows costs
    one row per task.
    """
    return hashed.groupBy("root_digest", "canonical").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def copies_of(hashed: DataFrame) -> DataFrame:
    """(first_id, id) of every record that repeats an earlier one. ``hashed`` is read twice and should be written.

    A row joins its group by digest, without its text; only rows of a digest that two
    different structures share (a collision) are compared whole. AQE splits the row side of
    a hot group.
    """
    groups = materialize(group_copies(hashed), "p5-groups")
    shared = groups.groupBy("root_digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root_digest")
    firsts = groups.where("copies > 1")
    if shared.isEmpty():
        met = hashed.select("root_digest", "id").join(firsts.select("root_digest", "first_id"), "root_digest")
    else:
        alone = hashed.select("root_digest", "id").join(shared, "root_digest", "left_anti").join(firsts.select("root_digest", "first_id"), "root_digest")
        whole = hashed.join(shared, "root_digest", "left_semi").join(firsts.select("root_digest", "canonical", "first_id"), ["root_digest", "canonical"])
        met = alone.select("first_id", "id").unionByName(whole.select("first_id", "id"))
    return met.where("first_id < id").select("first_id", "id")


#: The identity of a hypothesis: utt_id, rank and the letters and digits of text_raw.
HYPOTHESIS = Rules(identity=("utt_id", "rank", "text_raw"), leaves={"utt_id": exact, "rank": number})


def hypothesis_lines(lines: DataFrame) -> DataFrame:
    """Parse N-best lines and hash the hypothesis each one states.

    Lines without readable JSON, or without any of utt_id, rank and text_raw, state no
    hypothesis: they are left out and are nobody's copy. A null or missing single field
    equals only another null. Other payload fields and extra columns are ignored.
    """
    return with_root_digest(lines, "line_id", "payload", HYPOTHESIS)


def found(lines: DataFrame) -> DataFrame:
    """p5_found: (first_line_id, line_id)."""
    return copies_of(materialize(hypothesis_lines(lines), "p5-hashed")).withColumnsRenamed({"first_id": "first_line_id", "id": "line_id"})


def distinct_hypotheses(lines: DataFrame) -> DataFrame:
    """One row per distinct hypothesis: its first line and how many lines state it."""
    return group_copies(hypothesis_lines(lines)).select(F.col("first_id").alias("line_id"), "copies")
