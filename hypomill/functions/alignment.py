"""Token alignment with exact substitution, deletion and insertion counts.

Levenshtein distance with unit costs. Of equally cheap paths the one counts that, read from the
end, prefers a match, then substitution, then deletion, then insertion; carrying the counts
forward under the same preference gives the same numbers as a backtrace, with three diagonals.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hypomill.schemas import EDIT_COUNTS, EDIT_OPERATIONS

# the native form keeps cost, substitutions, deletions and insertions in one integer: comparing it shifted compares costs
_SUB, _DEL, _INS, _COST = 1 << 32, 1 << 16, 1, 1 << 48
_STEP_SUB, _STEP_DEL, _STEP_INS = _COST | _SUB, _COST | _DEL, _COST | _INS
#: Cells of one anti-diagonal of the batched table: as much as stays in a core's cache.
_CELLS = 100_000
#: Tokens of a pair up to which a cell fits into 32 bits.
_NARROW = 2_000


def _batch_counts(refs: list[Sequence], hyps: list[Sequence]) -> np.ndarray:
    """(pairs, 3): substitutions, deletions, insertions.

    All pairs of a batch advance together, an anti-diagonal of their tables at a time, whose
    cells do not depend on each other. A cell holds cost and substitutions; deletions and
    insertions follow from them and the lengths.
    """
    ids: dict = {}
    n = np.array([len(r) for r in refs], np.int64)
    m = np.array([len(h) for h in hyps], np.int64)
    out = np.zeros((len(refs), 3), np.int64)
    order = np.lexsort((m, n))
    at = 0
    while at < len(order):
        # neighbours in length share a table, so little of it is padding
        longest = int(n[order[min(at + 64, len(order)) - 1]]) + 1
        take = order[at : at + max(1, _CELLS // longest)]
        at += len(take)
        cost, substitutions = _tables([refs[k] for k in take], [hyps[k] for k in take], n[take], m[take], ids)
        deletions = (cost - substitutions - (m[take] - n[take])) // 2
        out[take, 0], out[take, 1], out[take, 2] = substitutions, deletions, cost - substitutions - deletions
    return out


def _tables(refs: list[Sequence], hyps: list[Sequence], n: np.ndarray, m: np.ndarray, ids: dict) -> tuple[np.ndarray, np.ndarray]:
    """(cost, substitutions) in the last cell of each pair's table."""
    rows, cols, pairs = int(n.max(initial=0)), int(m.max(initial=0)), len(refs)
    kind, low = (np.int32, 12) if rows + cols < _NARROW else (np.int64, 30)
    # cost, then the way the cell was reached (substitution before deletion before insertion), then substitutions: the least is the one preferred
    step = 1 << low + 2
    substitution, deletion, insertion = kind(step | 1), kind(step | 1 << low), kind(step | 2 << low)
    clear = kind(~(3 << low))
    ref = np.full((rows, pairs), -1, np.int32)
    backwards = np.full((cols, pairs), -2, np.int32)  # word j stands at cols - 1 - j
    for k, (r, h) in enumerate(zip(refs, hyps)):
        ref[: len(r), k] = [ids.setdefault(t, len(ids)) for t in r]
        if len(h):
            backwards[cols - len(h) :, k] = [ids.setdefault(t, len(ids)) for t in reversed(h)]
    by_end: dict[int, list[int]] = {}
    for k, end in enumerate((n + m).tolist()):
        by_end.setdefault(end, []).append(k)
    result = np.zeros(pairs, np.int64)
    # cell (i, d - i) of diagonal d stands in row i
    two, one, new = (np.zeros((rows + 1, pairs), kind) for _ in range(3))
    for d in range(1, rows + cols + 1):
        a, b = max(1, d - cols), min(rows, d - 1)
        if a <= b:
            diagonal, cells = two[a - 1 : b], new[a : b + 1]
            np.minimum(one[a - 1 : b] + deletion, one[a : b + 1] + insertion, out=cells)
            np.minimum(cells, diagonal + substitution, out=cells)
            np.bitwise_and(cells, clear, out=cells)
            first = cols - d + a  # word d - a - 1 of the hypothesis, then the ones before it
            np.copyto(cells, diagonal, where=ref[a - 1 : b] == backwards[first : first + b - a + 1])
        if d <= cols:
            new[0] = d * step
        if d <= rows:
            new[d] = d * step
        if d in by_end:
            k = np.array(by_end[d])
            result[k] = new[n[k], k]
        two, one, new = one, new, two
    return result >> low + 2, result & (1 << low) - 1


def _without_common_end(ref: Sequence, hyp: Sequence) -> tuple[Sequence, Sequence]:
    """Both without the tokens that they end in alike: read from the end, a match is always taken."""
    k, most = 0, min(len(ref), len(hyp))
    while k < most and ref[-1 - k] == hyp[-1 - k]:
        k += 1
    return ref[: len(ref) - k], hyp[: len(hyp) - k]


def _plain_counts(ref: Sequence, hyp: Sequence) -> tuple[int, int, int]:
    """One pair with counts of any size, for texts of tens of thousands of tokens."""
    last = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for i, r in enumerate(ref, 1):
        row = [(i, 0, i, 0)]
        for j, h in enumerate(hyp, 1):
            d, u, left = last[j - 1], last[j], row[j - 1]
            if r == h:
                row.append(d)
            elif d[0] <= u[0] and d[0] <= left[0]:
                row.append((d[0] + 1, d[1] + 1, d[2], d[3]))
            elif u[0] <= left[0]:
                row.append((u[0] + 1, u[1], u[2] + 1, u[3]))
            else:
                row.append((left[0] + 1, left[1], left[2], left[3] + 1))
        last = row
    return last[-1][1:]


def counts_of(refs: list[Sequence], hyps: list[Sequence]) -> np.ndarray:
    """(pairs, 4): substitutions, deletions, insertions and reference tokens."""
    out = np.zeros((len(refs), 4), np.int64)
    out[:, 3] = [len(r) for r in refs]
    rest = [_without_common_end(r, h) for r, h in zip(refs, hyps)]
    # of what is left, one empty side needs no table
    small = []
    for k, (r, h) in enumerate(rest):
        if not len(r) or not len(h):
            out[k, 1], out[k, 2] = len(r), len(h)
        elif len(r) + len(h) < 30_000:
            small.append(k)
        else:
            out[k, :3] = _plain_counts(r, h)
    if small:
        out[small, :3] = _batch_counts([rest[k][0] for k in small], [rest[k][1] for k in small])
    return out


def _udf(split):
    @F.pandas_udf(EDIT_COUNTS)
    def edit_counts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
        known = (reference.notna() & hypothesis.notna()).to_numpy()
        out = np.zeros((len(reference), 4), np.int64)
        if known.any():
            out[known] = counts_of([split(x) for x in reference[known]], [split(x) for x in hypothesis[known]])
        frame = pd.DataFrame(out, columns=["substitutions", "deletions", "insertions", "reference_tokens"])
        if not known.all():
            frame = frame.astype("Int64")
            frame.loc[~known, :] = pd.NA
        return frame

    return edit_counts


_word_udf = _udf(str.split)
_char_udf = _udf(lambda s: s.replace(" ", ""))


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Edit counts of two normalised texts over words. Fields are null where a text is."""
    return _word_udf(reference, hypothesis)


def char_edits(reference: Column, hypothesis: Column) -> Column:
    """Edit counts over characters without blanks."""
    return _char_udf(reference, hypothesis)


def errors(edits: Column) -> Column:
    return edits["substitutions"] + edits["deletions"] + edits["insertions"]


#: Cells from which a table of costs is filled a row at a time, in an array.
_ARRAY_CELLS = 5_000


def _costs(ref: Sequence[str], hyp: Sequence[str]):
    """Edit distances of all beginnings of two sequences, [i][j]."""
    n, m = len(ref), len(hyp)
    if n * m < _ARRAY_CELLS:
        rows = [list(range(m + 1))]
        for i, r in enumerate(ref, 1):
            last, row = rows[-1], [i]
            for j, h in enumerate(hyp, 1):
                row.append(min(last[j - 1] + (r != h), last[j] + 1, row[-1] + 1))
            rows.append(row)
        return rows
    ids: dict = {}
    x, y = (np.array([ids.setdefault(t, len(ids)) for t in ts], np.int32) for ts in (ref, hyp))
    at = np.arange(m + 1, dtype=np.int32)
    cost = np.empty((n + 1, m + 1), np.int16 if n + m < 2**15 else np.int32)
    cost[0] = at
    for i in range(1, n + 1):
        last = cost[i - 1].astype(np.int32)
        new = np.concatenate(([i], np.minimum(last[:-1] + (y != x[i - 1]), last[1:] + 1)))
        # insertions: the least of what stands further left, one dearer for each step
        cost[i] = np.minimum.accumulate(new - at) + at
    return cost


def trace_of(ref: Sequence[str], hyp: Sequence[str]) -> list[dict[str, str | None]]:
    """The alignment's operations in order. What both end in alike is a match and needs no table."""
    head, other = _without_common_end(ref, hyp)
    same = [dict(op="correct", ref=t, hyp=t) for t in ref[len(head) :]]
    ref, hyp = head, other
    cost = _costs(ref, hyp)
    i, j, steps = len(ref), len(hyp), []
    while i or j:
        here = cost[i][j]
        if i and j and ref[i - 1] == hyp[j - 1] and here == cost[i - 1][j - 1]:
            i, j, step = i - 1, j - 1, ("correct", ref[i - 1], hyp[j - 1])
        elif i and j and here == cost[i - 1][j - 1] + 1:
            i, j, step = i - 1, j - 1, ("substitution", ref[i - 1], hyp[j - 1])
        elif i and here == cost[i - 1][j] + 1:
            i, step = i - 1, ("deletion", ref[i - 1], None)
        else:
            j, step = j - 1, ("insertion", None, hyp[j - 1])
        steps.append(dict(zip(("op", "ref", "hyp"), step)))
    return steps[::-1] + same


@F.pandas_udf(EDIT_OPERATIONS)
def word_trace(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """The word operations of each pair; null where a text is null."""
    return pd.Series([None if r is None or h is None else trace_of(r.split(), h.split()) for r, h in zip(reference, hypothesis)])


def native_edits(ref: Column, hyp: Column) -> Column:
    """The same counts from two token arrays as one JVM expression, without Python.

    Slower than the Arrow form on long texts (lambdas are interpreted); kept to check it and
    for sessions without Python workers. Its counts have 16 bits each, so it raises an error for
    texts of more than 65,535 tokens in all.
    """
    zero = F.lit(0).cast("long")
    indexes = F.when(F.size(hyp) > 0, F.sequence(F.lit(1), F.size(hyp))).otherwise(F.array().cast("array<int>"))
    first = F.concat(F.array(zero), F.transform(indexes, lambda j: j * F.lit(_STEP_INS)))

    def next_row(row: Column, token: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            diagonal, up, left = F.get(row, j - 1), F.get(row, j), F.get(done, j - 1)
            cd, cu, cl = (F.shiftright(x, 48) for x in (diagonal, up, left))
            best = (
                F.when(F.get(hyp, j - 1) == token, diagonal).when((cd <= cu) & (cd <= cl), diagonal + F.lit(_STEP_SUB))
                .when(cu <= cl, up + F.lit(_STEP_DEL)).otherwise(left + F.lit(_STEP_INS))
            )
            return F.concat(done, F.array(best))

        return F.aggregate(indexes, F.array(F.get(row, F.lit(0)) + F.lit(_STEP_DEL)), cell)

    fits = F.when(F.size(ref) + F.size(hyp) > 0xFFFF, F.raise_error(F.lit("texts too long for 16-bit counts")).cast("bigint"))
    last = F.aggregate(ref, first, next_row)
    end = F.coalesce(fits, F.element_at(last, -1))

    def part(shift: int) -> Column:
        return F.shiftright(end, shift).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")

    return F.struct(part(32).alias("substitutions"), part(16).alias("deletions"), part(0).alias("insertions"), F.size(ref).alias("reference_tokens"))
