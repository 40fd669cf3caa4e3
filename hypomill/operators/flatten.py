"""Problem 6: deeply nested records become flat tables that keep the way to their record.

Every node of a record gets an interval label by depth-first traversal: ``pre`` on the way
down, ``post`` on the way up, from one counter per record. A node lies below another one
exactly if its interval lies inside the other's, so any two node tables can be linked
without knowing the path between them, segments in segments included. Open maps (JSON text) are walked to any depth; text
that itself holds JSON is opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypomill.operators.nbest import zipped

NODE_SCHEMA = (
    "child string, record_id long, pre long, post long, parent long, name string, hyp_pos int, pos_one int, pos_two int, "
    "number double, content string"
)
#: Kinds of nodes. Objects, arrays and scalars of the open maps that are neither segment nor word keep a node of their own.
KINDS = ("record", "hypothesis", "logprob", "segment", "word", "object", "array", "value")
_RECORD, _HYPOTHESIS, _LOGPROB, _SEGMENT, _WORD, _OBJECT, _ARRAY, _VALUE = range(len(KINDS))
#: Records opened at a time; bounds the memory of a Python worker.
SLICE = 128


def _open(value):
    """JSON text to what it holds; text that holds none to None."""
    while isinstance(value, str):
        if value.lstrip()[:1] not in ("{", "[", '"'):
            return None
        try:
            value = json.loads(value)
        except ValueError:
            return None
    return value


def _elements(value) -> list:
    """An array's elements; an object (or lone value) in place of an array is its only element."""
    if isinstance(value, str):
        opened = _open(value)
        value = value if opened is None else opened
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


class _Nodes:
    """Columns of the node table in depth-first order, and the one clock that labels its nodes."""

    def __init__(self, values: bool) -> None:
        self.values = values
        self.clock = 0
        self.kind, self.record, self.name, self.pos, self.pre, self.post, self.parent, self.number, self.content = ([] for _ in range(9))
        self.record_id, self.open = 0, [-1]

    def begin(self, kind: int, name: str | None = None, pos: int = -1, number=None, content=None) -> int:
        at = len(self.kind)
        for column, v in ((self.kind, kind), (self.record, self.record_id), (self.name, name), (self.pos, pos), (self.pre, self.clock), (self.post, -1), (self.parent, self.open[-1])):
            column.append(v)
        if self.values:
            self.number.append(number)
            self.content.append(content)
        self.open.append(self.clock)
        self.clock += 1
        return at

    def end(self, at: int) -> None:
        self.post[at] = self.clock
        self.clock += 1
        self.open.pop()

    def leaves(self, kind: int, n: int, numbers=None, contents=None, name: str | None = None) -> None:
        """n leaf siblings at positions 0, 1, ...; their labels are consecutive."""
        pre = self.clock
        for column, v in ((self.kind, kind), (self.record, self.record_id), (self.name, name), (self.parent, self.open[-1])):
            column.extend([v] * n)
        self.pos.extend(range(n))
        self.pre.extend(range(pre, pre + 2 * n, 2))
        self.post.extend(range(pre + 1, pre + 2 * n, 2))
        if self.values:
            self.number.extend(numbers or [None] * n)
            self.content.extend(contents or [None] * n)
        self.clock += 2 * n

    # --- open maps
    def walk(self, value, name: str | None, pos: int = -1, kind: int | None = None) -> None:
        """Label a value of an open map and everything below it, to any depth."""
        inner = _open(value) if isinstance(value, str) else value
        if isinstance(inner, dict):
            at = self.begin(_OBJECT if kind is None else kind, name, pos, *(_word_of(inner) if kind == _WORD else (None, None)))
            for key, below in inner.items():
                if key == "segments":
                    self.elements(below, key, _SEGMENT)
                elif key == "words" and kind == _SEGMENT:
                    self.elements(below, key, _WORD)
                else:
                    self.walk(below, key)
            self.end(at)
        elif isinstance(inner, list):
            at = self.begin(_ARRAY if kind is None else kind, name, pos)
            for i, below in enumerate(inner):
                self.walk(below, None, i)
            self.end(at)
        else:
            kept = value if inner is None else inner
            number = float(kept) if isinstance(kept, (int, float)) and not isinstance(kept, bool) else None
            self.end(self.begin(_VALUE if kind is None else kind, name, pos, number if kind is None else None, _text(kept)))

    def elements(self, value, name: str, kind: int) -> None:
        """The array ``name`` and its elements, which are nodes of one kind."""
        found = _elements(value)
        at = self.begin(_ARRAY, name)
        if kind == _WORD and all(not isinstance(x, dict) or x.keys() <= _WORD_FIELDS for x in found):
            texts = numbers = None
            if self.values:
                numbers, texts = zip(*(_word_of(x) if isinstance(x, dict) else (None, _text(x)) for x in found)) if found else ((), ())
            self.leaves(_WORD, len(found), numbers, texts)
        else:
            for i, x in enumerate(found):
                self.walk(x, None, i, kind)
        self.end(at)

    # --- rows
    def batch(self) -> pa.RecordBatch:
        """The node table's rows. What a node belongs to is read off the intervals: nodes below another
        one are the rows whose label lies between its two labels, the innermost one counting."""
        kind, pos, pre, post = (np.array(x, np.int64) for x in (self.kind, self.pos, self.pre, self.post))
        inside = {k: np.full(len(kind), -1, np.int32) for k in (_HYPOTHESIS, _SEGMENT)}
        for k, held in inside.items():
            first = np.flatnonzero(kind == k)
            for i, j in zip(first.tolist(), np.searchsorted(pre, post[first]).tolist()):
                held[i:j] = pos[i]  # an inner segment comes later and takes its own rows over
        hyp, segment, own = inside[_HYPOTHESIS], inside[_SEGMENT], pos.astype(np.int32)
        one = np.where(kind == _LOGPROB, own, segment)
        two = np.where(kind == _WORD, own, np.int32(-1))
        start = np.array(self.starts, np.int64)[np.searchsorted(self.starts, pre, side="right") - 1]  # labels count anew in each record
        parent = np.array(self.parent, np.int64)
        parent = pa.array(parent - start, mask=parent < 0)
        n = len(kind)
        number = pa.array(self.number, pa.float64()) if self.values else pa.nulls(n, pa.float64())
        content = pa.array(self.content, pa.string()) if self.values else pa.nulls(n, pa.string())
        child = pa.DictionaryArray.from_arrays(pa.array(kind.astype(np.int32)), pa.array(KINDS)).cast(pa.string())
        return pa.record_batch(
            [child, pa.array(self.record, pa.int64()), pa.array(pre - start), pa.array(post - start), parent, pa.array(self.name, pa.string()), pa.array(hyp), pa.array(one), pa.array(two), number, content],
            names=[f.split(" ")[0] for f in NODE_SCHEMA.split(", ")],
        )

    # --- records
    starts: list[int]

    def records(self, ids: list[int], hypotheses: list) -> None:
        self.starts = []
        for self.record_id, hyps in zip(ids, hypotheses):
            self.starts.append(self.clock)
            self.open = [-1]
            root = self.begin(_RECORD)
            for h, hyp in enumerate(hyps or ()):
                node = self.begin(_HYPOTHESIS, "hypotheses", h, *((hyp or {}).get(k) for k in ("rank", "text_raw")))
                if hyp is not None:
                    probs = hyp.get("token_logprobs")
                    self.leaves(_LOGPROB, max(0, hyp["n"] if "n" in hyp else len(probs or ())), probs, name="token_logprobs")
                    if hyp.get("metadata") is not None:
                        self.walk(hyp["metadata"], "metadata")
                self.end(node)
            self.end(root)


_WORD_FIELDS = {"w", "p"}


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _word_of(word: dict) -> tuple[float | None, str | None]:
    p = word.get("p")
    return float(p) if isinstance(p, (int, float)) and not isinstance(p, bool) else None, _text(word.get("w"))


def interval_nodes(records: DataFrame, values: bool = True) -> DataFrame:
    """One row per node of each record: its kind, interval label, parent's label, name and positions.

    (record_id, pre) is the key of a node. ``hyp_pos`` and, below a segment, ``pos_one`` are
    the positions of the hypothesis and of the innermost segment whose interval holds it;
    ``pos_two`` is a word's own position, and a logprob has its own in ``pos_one``. Null or
    missing levels have no nodes below them; a null array element is a node without children
    and keeps its position. Metadata that is no JSON is one ``value`` node. Numbers of
    ``logprob``, ``word`` and ``value`` nodes and the text of ``hypothesis``, ``word`` and
    ``value`` nodes are kept with ``values``; without, logprob arrays never leave the JVM.
    """
    hyps = F.col("asr.hypotheses")
    if values:
        light = zipped(hyps, "rank", "text_raw", "token_logprobs", "metadata")
    else:
        light = F.zip_with(zipped(hyps, sizes=("token_logprobs",)), zipped(hyps, "metadata"), lambda a, b: F.struct(a["token_logprobs"].alias("n"), b["metadata"].alias("metadata")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, out = batch.slice(at, SLICE), _Nodes(values)
                out.records(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield out.batch()

    return records.select("record_id", light.alias("hypotheses")).mapInArrow(run, NODE_SCHEMA)


def found(records: DataFrame) -> DataFrame:
    """p6_found: (child, record_id, hyp_pos, pos_one, pos_two) of every flat child row."""
    nodes = interval_nodes(records, values=False)
    return nodes.where(F.col("child").isin("hypothesis", "logprob", "word")).select("child", "record_id", "hyp_pos", "pos_one", "pos_two")


def flat_table(nodes: DataFrame, child: str) -> DataFrame:
    """The flat table of one node kind."""
    return nodes.where(F.col("child") == child)


def contained(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """Each node of ``lower`` with every node of ``upper`` whose interval holds it (same record)."""
    up = upper.select("record_id", F.col("pre").alias("up_pre"), F.col("post").alias("up_post"), F.col("hyp_pos").alias("up_hyp_pos"), F.col("content").alias("up_content"))
    return lower.join(up, "record_id").where("up_pre < pre and post < up_post")


def words(records: DataFrame) -> DataFrame:
    """The flat table of segment words, with their values and the key of their node."""
    w = flat_table(interval_nodes(records), "word")
    return w.select("record_id", F.col("pre").alias("node"), "hyp_pos", F.col("pos_one").alias("segment"), F.col("pos_two").alias("position"), F.col("content").alias("word"), F.col("number").alias("probability"))


def logprobs(records: DataFrame) -> DataFrame:
    """The flat table of token log-probabilities."""
    rows = flat_table(interval_nodes(records), "logprob")
    return rows.select("record_id", "hyp_pos", F.col("pos_one").alias("position"), F.col("number").alias("logprob"))
