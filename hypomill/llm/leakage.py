"""Problem 8: passages of held-out items that occur in corpus documents.

All items form one generalised suffix automaton over words. A document's words stream through
it; wherever the longest match reaches SEED words, the automaton gives every item position of
those words. Any run that counts (at least MIN_RUN item words, at most one word in EVERY
altered, dropped or added) holds an exact stretch of SEED words, so no case is missed; an
exact edit check around the seeds then decides, and gives the span to remove. Where a seed
stands in very many items (a stem they all begin with), the items are not opened one by one:
the words around the seed are compared with the document's in one array, and only items that
agree in enough of them are looked at.

Automata are built in tasks, a block of items each. The corpus is read once, whatever the
number of blocks: a task holds a batch of documents and takes one automaton after the other.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypomill.runtime import materialize

MIN_RUN = 12
EVERY = 6
#: 12 words with 2 edits leave 10 words in 3 pieces, so one has 4; longer runs leave more.
SEED = 4
#: Items are held in automata of about so many words each; more items mean more automata,
#: taken one after another, never one of unbounded size.
BLOCK_WORDS = 500_000
#: Items with a seed from which they are compared in one array.
HOT = 64
#: A run through an exact stretch of fewer than MIN_RUN words that holds a shorter one that counts has so many words at most.
_FAR = 3 * MIN_RUN

_word = re.compile(r"[^\W_]+")
#: Marks that a layout puts between words: speaker labels, numbers of lines, cues and turns.
_mark = re.compile(r"\[\d+\]|<\d+>|\bspeaker ?\d+ ?:|\bspk ?\d+ ?>")
# Numerals that a writer may spell out.
_NUMERALS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty"
).split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_spelled = {str(n): w for n, w in enumerate(_NUMERALS)} | {str(10 * n): w for n, w in enumerate(_TENS, 2)}


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, letter case, punctuation and layout ignored; numerals spelled out."""
    if not text:
        return []
    text = text.lower()
    if "[" in text or "<" in text or "sp" in text:
        text = _mark.sub(" ", text)
    found = _word.findall(text)
    if any(map(str.isdigit, found)):
        found = [_spelled.get(w, w) for w in found]
    return found


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in items]
        self.step: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(self.sequences):
            last = 0
            for at, w in enumerate(sequence):
                last = self._extend(last, w)
                self.ends[last].append((k, at))
        self.below: list[list[int]] = [[] for _ in self.link]
        for s, up in enumerate(self.link):
            if up >= 0:
                self.below[up].append(s)
        self._known: dict[int, list[tuple[int, int]]] = {}
        # all items behind each other, with room between them: flat[_start[k] + i] is word i of item k
        size = np.array([len(x) for x in self.sequences], np.int64)
        self._start = np.concatenate(([0], np.cumsum(size + _FAR)[:-1])) + _FAR if len(size) else size
        self._flat = np.full(int((size + _FAR).sum()) + _FAR, -1, np.int32)
        for at, x in zip(self._start, self.sequences):
            self._flat[at : at + len(x)] = x
        self._hot: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.longest.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The part of q reached from p, as a state of its own."""
        clone = self._state(self.longest[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, w: int) -> int:
        q = self.step[p].get(w)
        if q is not None:  # an earlier item has this prefix
            return q if self.longest[q] == self.longest[p] + 1 else self._split(p, w, q)
        new = self._state(self.longest[p] + 1, {}, 0)
        while p != -1 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.step[p][w]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, w, q)
        return new

    def occurrences(self, state: int) -> list[tuple[int, int]]:
        """(item, last word's position) of every occurrence of a state's words."""
        if state not in self._known:
            found, todo = [], [state]
            while todo:
                s = todo.pop()
                found += self.ends[s]
                todo += self.below[s]
            self._known[state] = found
        return self._known[state]

    def agreeing(self, state: int, at: int, doc: np.ndarray) -> list[tuple[int, int]]:
        """Of a hot state's occurrences (item, last word's position) those that can be part of a run that counts.

        ``doc``: the document's words with _FAR + SIDE_EDITS words of room on both sides;
        ``at``: the seed's last word in it. Judged at the first seed of an exact stretch: a
        run of n item words through it agrees with the document in its first and last and in
        n - n // EVERY of them, each at most SIDE_EDITS - 1 words off its place.
        """
        if state not in self._hot:
            found = np.array(self.occurrences(state), np.int64)
            self._hot[state] = found[:, 0], self._start[found[:, 0]] + found[:, 1]
        items, base = self._hot[state]
        first = np.flatnonzero(self._flat[base - SEED] != doc[at - SEED])
        kept = []
        most_off = SIDE_EDITS - 1
        left, right = 2 * MIN_RUN - 1 - SEED, _FAR - 1 - SEED
        offsets = np.arange(-left - SEED + 1, right + 1)
        seed = (offsets > -SEED) & (offsets <= 0)
        other = offsets[~seed]
        near = doc[at + other[:, None] + np.arange(-most_off, most_off + 1)]
        for i in range(0, len(first), 20_000):
            part = first[i : i + 20_000]
            words = self._flat[base[part][:, None] + other]
            hits = words == near[:, 0]
            for j in range(1, near.shape[1]):
                hits |= words == near[:, j]
            upto = np.zeros((len(part), len(offsets) + 1), np.int16)
            agree = np.ones((len(part), len(offsets)), bool)
            agree[:, ~seed] = hits
            np.cumsum(agree, 1, out=upto[:, 1:])
            fine = np.zeros(len(part), bool)
            last = left + SEED - 1  # the column of the seed's last word
            for n in range(MIN_RUN, _FAR):
                begin = range(max(0, last - n + 1), min(left, len(offsets) - n) + 1)
                if len(begin):
                    here = slice(begin.start, begin.stop)
                    enough = upto[:, begin.start + n : begin.stop + n] - upto[:, here] >= n - n // EVERY
                    fine |= (enough & agree[:, here] & agree[:, begin.start + n - 1 : begin.stop + n - 1]).any(1)
            kept += [(int(items[k]), int(base[k] - self._start[items[k]])) for k in part[fine]]
        return kept

    def seeds(self, words: list[int | None]) -> list[tuple[int, int]]:
        """(document position, state of the SEED words ending there) along one document."""
        step, link, longest = self.step, self.link, self.longest
        root = step[0]
        state = length = 0
        found = []
        for at, w in enumerate(words):
            if w is None:
                state = length = 0
                continue
            to = step[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = step[state].get(w)
                length = longest[state]
                if to is None:
                    to, length = root.get(w, 0), -1 if w not in root else 0
            state, length = to, length + 1
            if length >= SEED:
                s = state
                while longest[link[s]] >= SEED:
                    s = link[s]
                found.append((at, s))
        return found

    def passages(self, words: list[str], whole: bool = True) -> dict[int, list[tuple[int, int]]]:
        """Item index to the (first, last) document words of every passage of it, in order.

        Where it only matters whether there is one, not ``whole`` gives some part of one that counts.
        """
        ids = [*map(self.vocabulary.get, words)]
        at_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
        room = _FAR + SIDE_EDITS
        doc = None
        for at, state in self.seeds(ids):
            found = self.occurrences(state)
            if len(found) > HOT:
                if doc is None:
                    doc = np.full(len(ids) + 2 * room, -2, np.int32)
                    doc[room : room + len(ids)] = [-2 if w is None else w for w in ids]
                found = self.agreeing(state, at + room, doc)
            for k, end in found:
                at_item[k].append((end, at))
        found = {}
        for k, pairs in at_item.items():
            runs = leaked_runs(self.sequences[k], ids, pairs, whole)
            if runs:
                found[k] = runs
        return found

    def matches(self, words: list[str]) -> dict[int, tuple[int, int]]:
        """Item index to the (first, last) document word of the longest passage of it."""
        return {k: max(runs, key=lambda r: r[1] - r[0]) for k, runs in self.passages(words).items()}


def leaked_runs(item: list[int], doc: list[int | None], seeds: list[tuple[int, int]], whole: bool = True) -> list[tuple[int, int]]:
    """Document spans of all words in a run of ``item``, given the ends of all exact SEED-word stretches.

    Each exact stretch is widened on both sides with as few edits as possible. A run begins
    and ends with an agreeing word and has at least MIN_RUN item words for at most one edit
    in EVERY of them. A longer run always holds one of fewer than 2 * MIN_RUN words that
    counts as well (one half of it has no more edits a word), so SIDE_EDITS are enough to tell
    whether a stretch counts. One that does is then widened with as many edits as the whole
    item may have, as far to the left and as far to the right as a run through it goes.
    Overlapping spans are one. Not ``whole``: the first stretch that counts, as far as SIDE_EDITS go.
    """
    seen = set(seeds)
    stretches = []
    for end, at in seeds:
        if (end - 1, at - 1) in seen:
            continue
        first, first_at, run = end - SEED + 1, at - SEED + 1, SEED  # the exact stretch that begins here
        while (end + 1, at + 1) in seen:
            end, at, run = end + 1, at + 1, run + 1
        stretches.append((run, first, first_at))
    found: list[tuple[int, int]] = []
    most = len(item) // EVERY
    for run, first, first_at in sorted(stretches, reverse=True):
        end, at = first + run, first_at + run
        low, high = max(0, first_at - first - most), min(len(doc), at + len(item) - end + most) - 1
        if any(a <= low and high <= b for a, b in found):  # no run through it reaches a new word
            continue
        for edits in (SIDE_EDITS, most) if whole else (SIDE_EDITS,):
            left = _widen(item, doc, first - 1, first_at - 1, -1, edits)
            right = _widen(item, doc, end, at, 1, edits)
            admitted = [
                (d_left, d_right) for x, (n_left, d_left) in enumerate(left) for y, (n_right, d_right) in enumerate(right)
                if (size := run + n_left + n_right) >= MIN_RUN and (x + y) * EVERY <= size
            ]
            if not admitted:
                break
        else:
            a, b = first_at - max(d for d, _ in admitted), at - 1 + max(d for _, d in admitted)
            if not whole:
                return [(a, b)]
            apart = [r for r in found if r[1] < a or b < r[0]]
            joined = [r for r in found if not (r[1] < a or b < r[0])] + [(a, b)]
            found = [*apart, (min(r[0] for r in joined), max(r[1] for r in joined))]
    return sorted(found)


SIDE_EDITS = 4


def _widen(item: list[int], doc: list[int | None], i: int, d: int, way: int, most_edits: int) -> list[tuple[int, int]]:
    """For 0, 1, ... edits: the most (item words, document words) agreed on beyond (i, d); it ends where no word of the item is left."""
    n, m = (len(item) - i, len(doc) - d) if way > 0 else (i + 1, d + 1)
    best, reached = [], {0: 0}  # item words passed, by document words ahead of item words
    most = (0, 0)
    for edits in range(most_edits + 1):
        if edits:
            to: dict[int, int] = {}
            for ahead, x in reached.items():
                for other, y in ((ahead, x + 1), (ahead - 1, x + 1), (ahead + 1, x)):
                    if y <= n and 0 <= y + other <= m and to.get(other, -1) < y:
                        to[other] = y
            reached = to
        for ahead, x in reached.items():
            y = x
            while y < n and y + ahead < m and item[i + way * y] == doc[d + way * (y + ahead)]:
                y += 1
            reached[ahead] = y
            if y > x and y > most[0]:
                most = (y, y + ahead)
        best.append(most)
        if most[0] == n:
            break
    return best


def blocks(items: DataFrame) -> DataFrame:
    """(block, automaton): pickled automata of all items with at least MIN_RUN words, each built in a task; written."""
    size = items.select(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("n")).first().n
    count = max(1, -(-size // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(count)).cast("int").alias("block")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((int(i), words_of(t)) for i, t in zip(frame["item_id"], frame["text"]))
        automaton = SuffixAutomaton([(i, ws) for i, ws in rows if len(ws) >= MIN_RUN])
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "automaton": [pickle.dumps(automaton, pickle.HIGHEST_PROTOCOL)]})

    known = items.where("text is not null and item_id is not null").select("item_id", "text", block)
    return materialize(known.groupBy("block").applyInPandas(build, "block int, automaton binary"), "p8-automata")


class Shared:
    """Automata on their way to the executors. A worker has one of them open at a time."""

    def __init__(self, sent: list) -> None:
        self.sent = sent
        self.open: tuple[int, SuffixAutomaton] | None = None

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "open": None}

    def __iter__(self) -> Iterator[SuffixAutomaton]:
        for i, broadcast in enumerate(self.sent):
            if self.open is None or self.open[0] != i:
                self.open = None
                self.open = i, pickle.loads(broadcast.value)
                if len(self.sent) > 1:
                    del broadcast._value  # read again from the executor's disk when its turn comes
            yield self.open[1]


def shared(items: DataFrame) -> Shared:
    """Send the blocks' automata out, one after the other through the driver, each bounded by its block's words."""
    sc = items.sparkSession.sparkContext
    return Shared([sc.broadcast(bytes(r.automaton)) for r in blocks(items).toLocalIterator()])


#: Bytes of text that a task holds in words at a time.
SLICE_BYTES = 8_000_000


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) in pieces of about SLICE_BYTES, a document whole."""
    for batch in batches:
        size = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, SLICE_BYTES + (size[at - 1] if at else 0), side="right")))
            yield batch.slice(at, to - at)
            at = to


def _scanned(documents: DataFrame, items: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): every passage, or a part of one passage of each item. One pass over the documents."""
    automata = shared(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            docs = [(d, words_of(t)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t]
            out: list[list[int]] = [[], [], [], []]
            for automaton in automata:
                for doc, words in docs:
                    for k, runs in automaton.passages(words, whole).items():
                        for a, b in runs:
                            for column, v in zip(out, (doc, automaton.ids[k], a, b)):
                                column.append(v)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["doc_id", "item_id", "first_word", "last_word"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, first_word long, last_word long")


def spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, last_word) of every passage of an item in a document, whole.

    Null and empty texts and items of fewer than MIN_RUN words match nothing; a repeated
    document counts under each doc_id. One row per document, item and passage; passages of one
    item that overlap are one row.
    """
    return _scanned(documents, items, True)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p8_found: (doc_id, item_id); one row per document and item, however many passages it holds."""
    return _scanned(documents, items, False).select("doc_id", "item_id")


#: Share of a document's words in passages from which the whole document goes.
MOST_LEAKED = 0.5


def word_places(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """``words_of`` a text with each word's place in it."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lowered; they stay as they are, so places hold
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    low = _mark.sub(lambda m: " " * len(m[0]), low)
    found = [*_word.finditer(low)]
    return [_spelled.get(m[0], m[0]) for m in found], [m.span() for m in found]


def take_out(left: list[str], automaton: SuffixAutomaton) -> None:
    """Replace the words of all passages of an automaton's items by GONE, passage by passage, until none is found."""
    while found := automaton.passages(left):
        for runs in found.values():
            for first, last in runs:
                left[first : last + 1] = [GONE] * (last + 1 - first)


#: Stands for a word that was taken out; no text has it.
GONE = "\x00"


def rest_of(text: str, left: list[str], places: list[tuple[int, int]]) -> str:
    """A text without its words that are GONE. What stands between taken words goes with them; the rest stays as it was."""
    gone = [w == GONE for w in left]
    words = left
    kept, at, i = [], 0, 0
    while i < len(words):
        if gone[i]:
            j = i
            while j + 1 < len(words) and gone[j + 1]:
                j += 1
            kept.append(text[at : places[i][0]])
            at = places[j][1]
            i = j
        i += 1
    kept.append(text[at:])
    return "".join(kept)


def without_passages(text: str, automata_: Iterable[SuffixAutomaton]) -> tuple[str, int, int]:
    """A text without any passage of an item: (text, its words, words taken out)."""
    words, places = word_places(text)
    for automaton in automata_:
        take_out(words, automaton)
    return rest_of(text, words, places), len(words), words.count(GONE)


def cleaned(documents: DataFrame, items: DataFrame, most: float = MOST_LEAKED) -> DataFrame:
    """(doc_id, words, leaked_words, text) of every document; passages of items are taken out of the text.

    Where more than ``most`` of the words are in passages the text is null. Null and empty
    texts stay as they are.
    """
    automata = shared(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            split = [word_places(t) if t else ([], []) for t in texts]
            for automaton in automata:
                for words, _ in split:
                    take_out(words, automaton)
            n, gone = [len(w) for w, _ in split], [w.count(GONE) for w, _ in split]
            left = [t if not k else None if k > most * m else rest_of(t, w, p) for t, (w, p), m, k in zip(texts, split, n, gone)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=["doc_id", "words", "leaked_words", "text"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, words long, leaked_words long, text string")
