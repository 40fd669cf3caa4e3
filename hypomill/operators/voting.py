"""One text from several candidates: aligned word by word to the first, each place decided by vote."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hypomill.functions.alignment import trace_of


def vote_words(candidates: Sequence[Sequence[str]]) -> list[str]:
    """The voted word sequence. The first candidate gives the places and wins ties; a place between
    two of its words takes a word if most candidates have the same one there."""
    if not candidates:
        return []
    base = list(candidates[0])
    at = [Counter({w: 1}) for w in base]
    between: list[Counter] = [Counter() for _ in range(len(base) + 1)]
    for other in candidates[1:]:
        place, added = 0, []
        for step in trace_of(base, other):
            if step["op"] == "insertion":
                added.append(step["hyp"])
                continue
            if added:
                between[place][tuple(added)] += 1
                added = []
            at[place][step["hyp"]] += 1  # None: the candidate has no word here
            place += 1
        if added:
            between[place][tuple(added)] += 1
    out: list[str] = []
    for place in range(len(base) + 1):
        extra, votes = max(between[place].items(), key=lambda kv: (kv[1], kv[0]), default=((), 0))
        if 2 * votes > len(candidates):
            out += extra
        if place < len(base):
            most = max(at[place].values())
            word = base[place] if at[place][base[place]] == most else min((w for w, n in at[place].items() if n == most), key=lambda w: w or "")
            out += [word] if word is not None else []
    return out


@F.pandas_udf(T.StringType())
def vote(texts: pd.Series) -> pd.Series:
    """The voted text of each array of normalised texts in rank order; null without texts."""
    def one(ts):
        known = [] if ts is None else [t.split() for t in ts if t is not None]
        return " ".join(vote_words(known)) if known else None

    return texts.map(one)
