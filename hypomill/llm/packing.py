"""Problem 7: documents into containers of fixed capacity, with little space unused.

Bounded-space online packing: every partition keeps at most OPEN open windows per container
kind, puts each document where it fits best, and emits the fullest window when none fits.
The windows still open at a partition's end are few (OPEN a partition and kind, whatever the
number of documents); they are merged as whole windows by the same rule in rounds, each round
in FAN_IN times fewer tasks, so no task ever holds an unbounded number.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypomill.llm.tokens import TOKENIZER_DIR, TokenCounter
from hypomill.runtime import materialize

#: Open windows per partition and container kind.
OPEN = 256
#: Partitions whose leftover windows one merging task takes.
FAN_IN = 16
PIECES = (
    "bin_name string, doc_id long, piece int, first_token long, tokens long, window string, window_tokens long, open boolean"
)


class Packer:
    """Best-fit packing with a bounded number of open windows. Items are any objects."""

    def __init__(self, capacity: int, most_open: int = OPEN) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.free: list[tuple[int, int]] = []  # (space left, window), ordered
        self.content: dict[int, list] = {}
        self.next = 0

    def put(self, size: int, item) -> tuple[int, int, list] | None:
        """Place an item of at most the capacity; gives the window emitted to make room, if any."""
        emitted = None
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            left, window = self.free.pop(k)
        else:
            if len(self.free) >= self.most_open:
                emitted = self._close(0)
            left, window = self.capacity, self.next
            self.content[window] = []
            self.next += 1
        self.content[window].append(item)
        insort(self.free, (left - size, window))
        if left == size and emitted is None:
            emitted = self._close(0)  # a full window need not stay open
        return emitted

    def _close(self, k: int) -> tuple[int, int, list]:
        left, window = self.free.pop(k)
        return window, self.capacity - left, self.content.pop(window)

    def leftovers(self) -> Iterator[tuple[int, int, list]]:
        while self.free:
            yield self._close(0)


def pieces_of(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(first token, tokens) of a document's pieces: one, unless it alone exceeds the capacity."""
    if tokens <= capacity:
        return [(0, tokens)]
    return [(a, min(capacity, tokens - a)) for a in range(0, tokens, capacity)]


def token_counts(documents: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, tokens) of every document; a null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or TokenCounter(folder)
            n = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, tokens long")


def _task() -> str:
    from pyspark import TaskContext

    return str(TaskContext.get().partitionId())


def _pack(kinds: list[tuple[str, int]], most_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = [(name, Packer(capacity, most_open)) for name, capacity in kinds]
        task = _task()
        for batch in batches:
            out = _Rows()
            docs, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, packer in packers:
                for doc, size in zip(docs, sizes):
                    for k, (first, n) in enumerate(pieces_of(size, packer.capacity)):
                        emitted = packer.put(n, (doc, k, first, n))
                        if emitted:
                            out.add(name, f"{name}/{task}/{emitted[0]}", emitted[1], emitted[2], False)
            yield out.batch()
        out = _Rows()
        for name, packer in packers:
            for window, used, items in packer.leftovers():
                out.add(name, f"{name}/{task}/{window}", used, items, used < packer.capacity)
        yield out.batch()

    return run


class _Rows:
    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in range(8)]

    def add(self, name: str, window: str, used: int, items: list, is_open: bool) -> None:
        n = len(items)
        doc, piece, first, size = zip(*items)
        for column, v in zip(self.columns, ([name] * n, doc, piece, first, size, [window] * n, [used] * n, [is_open] * n)):
            column.extend(v)

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = [f.split(" ")[0] for f in PIECES.split(", ")]
        return pa.record_batch([pa.array(c, t) for c, t in zip(self.columns, kinds)], names=names)


def _merge(kinds: list[tuple[str, int]], most_open: int, round_no: int, last: bool):
    """Whole leftover windows into windows: (bin_name, window, used) to the window each one joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = {name: Packer(capacity, most_open) for name, capacity in kinds}
        task, rows = _task(), [[], [], [], [], []]

        def emit(name, window, used, items, is_open):
            target = f"{name}/m{round_no}.{task}/{window}"
            for old in items:
                for column, v in zip(rows, (name, old, target, used, is_open)):
                    column.append(v)

        for batch in batches:
            # large ones first: the rest fills their gaps
            taken = sorted(zip(*(batch.column(i).to_pylist() for i in range(3))), key=lambda r: (-r[2], r[1]))
            for name, window, used in taken:
                emitted = packers[name].put(used, window)
                if emitted:
                    emit(name, *emitted, False)
        for name, packer in packers.items():
            for window, used, items in packer.leftovers():
                emit(name, window, used, items, not last)
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, types)], names=["bin_name", "window", "target", "used", "open"])

    return run


def pack(sizes: DataFrame, kinds: list[tuple[str, int]], most_open: int = OPEN) -> DataFrame:
    """(bin_name, doc_id, piece, first_token, tokens, container, container_tokens).

    ``sizes``: doc_id, tokens. Every document is packed once for each container kind. One of
    more tokens than the capacity is cut into full pieces and one rest, any other stays whole.
    A document of 0 tokens takes no space but has a container. Repeated doc_ids count singly.
    """
    packed = materialize(sizes.select("doc_id", "tokens").mapInArrow(_pack(kinds, most_open), PIECES), "p7-packed")
    windows = packed.where("open").groupBy("bin_name", "window").agg(F.first("window_tokens").alias("used"))
    moves = None
    count = windows.count()
    round_no = 0
    while count:
        per_task = FAN_IN * most_open * len(kinds)
        tasks = -(-count // per_task)
        last = tasks == 1
        merged = materialize(
            windows.repartition(tasks, "window").mapInArrow(
                _merge(kinds, most_open, round_no, last), "bin_name string, window string, target string, used long, open boolean"
            ),
            "p7-merged",
        )
        step = merged.select("window", "target", F.col("used").alias("target_tokens"))
        moves = step if moves is None else (
            moves.alias("m").join(step.alias("s"), F.col("m.target") == F.col("s.window"), "left").select(
                "m.window", F.coalesce("s.target", "m.target").alias("target"), F.coalesce("s.target_tokens", "m.target_tokens").alias("target_tokens"))
        )
        if last:
            break
        windows = merged.where("open").groupBy("bin_name", F.col("target").alias("window")).agg(F.first("used").alias("used"))
        count = windows.count()
        round_no += 1
    columns = ["bin_name", "doc_id", "piece", "first_token", "tokens"]
    closed = packed.where("not open") if moves is not None else packed
    closed = closed.select(*columns, F.col("window").alias("container"), F.col("window_tokens").alias("container_tokens"))
    if moves is None:
        return closed
    # only windows that were left open can have moved
    met = packed.where("open").join(moves, "window", "left")
    return closed.unionByName(met.select(*columns, F.coalesce("target", "window").alias("container"), F.coalesce("target_tokens", "window_tokens").alias("container_tokens")))


def kinds_of(limits: DataFrame) -> list[tuple[str, int]]:
    """The container kinds; null or non-positive capacities are no container."""
    rows = limits.where("bin_name is not null and capacity_tokens > 0").select("bin_name", "capacity_tokens").collect()
    return sorted((r.bin_name, int(r.capacity_tokens)) for r in rows)


def pack_documents(documents: DataFrame, limits: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    return pack(token_counts(documents, folder), kinds_of(limits))
