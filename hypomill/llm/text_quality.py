"""Problem 9: per-document text statistics, and the kind of each text that is not prose.

Statistics are computed in one pass over each text. A Gaussian mixture is fitted to the
standardised statistics of *all* documents by expectation-maximization; each iteration is one
distributed pass that returns only sufficient statistics (their size depends on components and
statistics, never on the data). No label takes part: the fit begins with one component, splits
every component along its widest statistic, and goes on as long as the Bayesian information
criterion gets better. Then each component is mapped to the kind of the inspected examples
(``quality_examples``) that are most likely under it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypomill.runtime import materialize

# Frequent function words of the corpus' languages.
COMMON_WORDS = frozenset(
    "the a an and or but of to in on at by for with from as is was are were be been this that these those it its his her "
    "their our your my he she they we you i not no so if when while because although until before after since whereas "
    "each every some any another all into onto over under near above below behind beside between through along across "
    "around against among beneath beyond inside outside past toward within upon there here what which who how "
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen twenty thirty forty fifty "
    "sixty seventy eighty ninety "
    "der die das den dem des ein eine einen einem einer und oder aber nicht mit von zu im am auf für ist war als auch "
    "sich weil denn wenn obwohl während sobald nach vor hinter unter neben gegen ohne "
    "le la les un une des du de et ou mais ne pas avec pour dans sur sans au aux en est que qui car puisque quand "
    "pendant avant après derrière sous comme "
    "el los las una unos unas y o pero con por para del al es que porque aunque cuando mientras sin antes después "
    "detrás bajo hacia sobre junto".split()
)

STATISTICS = (
    "log_words", "word_length", "symbol_ratio", "digit_ratio", "line_end_punct", "common_share", "line_words",
    "segment_words", "field_regular", "bullet_share", "odd_words", "odd_chars", "squeeze", "inline_marks", "tag_share",
    "sentence_share", "blank_runs", "lower_share",
)

_words = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_bullet = re.compile(r"\s*(?:[-–—*•+·▪>]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\(?[ivx]{1,4}[.)]|#\d+|\[[ x]\])\s+(?=\S)")
_speaker = re.compile(r"\s*(?:speaker ?\d+ ?:|spk ?\d+ ?>|\[\d{1,2}\])\s", re.I)
_segments = re.compile(r"[.!?;:|/,•·\t\n]+|\s[-–—]\s| {2,}")
_tag = re.compile(r"</?[a-zA-Z][^<>\n]*>|&[a-z]+;")
_sentence = re.compile(r"[.!?…][\"'”»)]*(?=\s|$)")
_odd_word = re.compile(r"[bcdfghjklmnpqrstvwxzß]{5}|^[^aeiouyáéíóúàèùâêîôûäöüœæëï]+$", re.I)
_normal = re.compile(r"[^\x20-\x7e\n\täöüÄÖÜßéèêëàâçîïôûùœæÉÈÀÇáíóúñÁÍÓÚÑ¿¡’‘“”«»…–—•]")
_marks = re.compile(r"\||;|\t|,| / | {2,}|=|•|·")
_flags: dict[str, tuple[bool, bool]] = {}  # (common, odd) of words met before
_delimiters = ("\t", "|", ";", ",", "=")


def _field_regularity(lines: list[str]) -> float:
    """Share of lines with the same number (1 or more) of the same field delimiter."""
    if len(lines) < 2:
        return 0.0
    best = 0.0
    for d in _delimiters:
        counts = Counter(x.count(d) for x in lines)
        counts.pop(0, None)
        if counts:
            n, times = counts.most_common(1)[0]
            best = max(best, times / len(lines) * (1.0 if n > 1 or d in "\t|" else 0.7))
    wide = sum(1 for x in lines if "  " in x.strip())
    return max(best, wide / len(lines))


def statistics(text: str) -> list[float]:
    """STATISTICS of one whole non-empty text."""
    lines = [x for x in text.split("\n") if x.strip()] or [text]
    words = _words.findall(text)
    n, chars = len(words), len(text)
    solid = chars - text.count(" ") - text.count("\n") - text.count("\t")
    letters = sum(map(len, words))
    digits = sum(map(text.count, "0123456789"))
    common = odd = 0
    for w, times in Counter(words).items():
        flag = _flags.get(w)
        if flag is None:
            if len(_flags) > 200_000:
                _flags.clear()
            flag = _flags[w] = (w.lower() in COMMON_WORDS, len(w) > 1 and _odd_word.search(w) is not None)
        common += times * flag[0]
        odd += times * flag[1]
    spoken = sum(1 for x in lines if _speaker.match(x))
    bullets = sum(1 for x in lines if _bullet.match(x))
    ends = sum(1 for x in lines if x.rstrip(" \"'”»)")[-1:] in (".", "!", "?", "…"))
    segments = [s for s in _segments.split(text) if s.strip()]
    sentences = len(_sentence.findall(text))
    tokens = text.split()
    packed = len(zlib.compress(text.encode("utf-8", "replace"), 1))
    return [
        math.log1p(n),
        letters / n if n else 0.0,
        max(0, solid - letters - digits) / max(1, solid),
        digits / max(1, solid),
        ends / len(lines),
        common / n if n else 0.0,
        math.log1p(len(tokens) / len(lines)),
        math.log1p(len(tokens) / max(1, len(segments))),
        _field_regularity(lines),
        max(0, bullets - spoken) / len(lines),
        odd / n if n else 1.0,
        len(_normal.findall(text)) / max(1, solid),
        min(1.5, packed / (chars + 30)) if chars < 60 else packed / chars,
        len(_marks.findall(text)) / max(1, len(tokens)),
        min(1.0, len(_tag.findall(text)) / len(lines)),
        min(1.0, 8 * sentences / max(1, len(tokens))),
        text.count("  ") / max(1, len(tokens)),
        sum(1 for x in lines if x.lstrip()[:1].islower()) / len(lines),
    ]


#: The mixture sees the statistics that do not grow with a text's length.
FITTED = [i for i, n in enumerate(STATISTICS) if n != "log_words"]
#: Square roots of shares spread the small values, where most texts differ.
_ROOTED = [STATISTICS.index(n) for n in (
    "symbol_ratio", "digit_ratio", "bullet_share", "odd_words", "odd_chars", "inline_marks", "tag_share", "blank_runs")]
#: Components are split up to so many.
MOST_COMPONENTS = 128
#: Iterations after a split, and at most after the last one.
ROUNDS, LAST_ROUNDS = 2, 4
#: Gain of log-likelihood per document under which the last rounds end.
CONVERGED = 1e-3
#: Least variance of a standardised statistic within a component.
FLOOR = 0.02
#: A component is split if it has so many documents and is wider than the floor.
SPLIT_DOCUMENTS, SPLIT_WIDTH = 20, 1.5 * FLOOR
#: Standardised values are held within this distance of the mean.
REACH = 6.0


def design(statistic_rows: np.ndarray) -> np.ndarray:
    """The fitted columns, shares as square roots."""
    x = np.array(statistic_rows, float)
    x[:, _ROOTED] = np.sqrt(np.maximum(x[:, _ROOTED], 0))
    return x[:, FITTED]


class Mixture:
    """Gaussian mixture with diagonal covariances over standardised statistics."""

    def __init__(self, center: np.ndarray, scale: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> None:
        self.center, self.scale, self.weight, self.mean, self.var = center, scale, weight, mean, var
        self._linear = np.hstack([-0.5 / var, mean / var]).T.astype(np.float32)
        self._constant = (-0.5 * (mean * mean / var + np.log(2 * np.pi * var)).sum(1)).astype(np.float32)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -REACH, REACH).astype(np.float32)

    def densities(self, z: np.ndarray) -> np.ndarray:
        """[row, component]: log density of each row under each component."""
        return np.hstack([z * z, z]) @ self._linear + self._constant

    def responsibilities(self, z: np.ndarray) -> tuple[np.ndarray, float]:
        """[row, component] shares, and the rows' log-likelihood."""
        log = self.densities(z) + np.log(np.maximum(self.weight, 1e-12)).astype(np.float32)
        top = log.max(1, keepdims=True)
        log -= top
        r = np.exp(log, out=log)
        total = r.sum(1, keepdims=True)
        r /= total
        return r, float(top.sum(dtype=float) + np.log(total).sum(dtype=float))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """[component, 1 + weights + moments]: the share of the log-likelihood, documents, sums and squares."""
        z = self.standard(x)
        r, likelihood = self.responsibilities(z)
        out = np.hstack([np.zeros((r.shape[1], 1)), r.sum(0, dtype=float)[:, None], (r.T @ np.hstack([z, z * z])).astype(float)])
        out[0, 0] = likelihood
        return out

    def moved(self, sums: np.ndarray) -> "Mixture":
        """The mixture after one iteration; a component that no document belongs to is gone."""
        d = len(self.center)
        sums = sums[sums[:, 1] > 1e-6]
        n = sums[:, 1:2]
        mean = sums[:, 2 : d + 2] / n
        var = np.maximum(sums[:, d + 2 :] / n - mean**2, FLOOR)
        return Mixture(self.center, self.scale, n[:, 0] / n.sum(), mean, var)

    def split(self, documents: float) -> "Mixture | None":
        """Every component of enough documents in two along its widest statistic; None if there is none."""
        k = np.flatnonzero((self.weight * documents >= SPLIT_DOCUMENTS) & (self.var.max(1) > SPLIT_WIDTH))
        if not len(k):
            return None
        widest = self.var[k].argmax(1)
        step, var = np.zeros((len(k), len(self.center))), self.var[k].copy()
        at = np.arange(len(k)), widest
        step[at] = 0.8 * np.sqrt(var[at])
        var[at] = np.maximum(0.4 * var[at], FLOOR)
        rest = np.setdiff1d(np.arange(len(self.mean)), k)
        return Mixture(
            self.center, self.scale, np.concatenate([self.weight[rest], self.weight[k] / 2, self.weight[k] / 2]),
            np.vstack([self.mean[rest], self.mean[k] + step, self.mean[k] - step]), np.vstack([self.var[rest], var, var]))

    def criterion(self, likelihood: float, documents: float) -> float:
        """Bayesian information criterion; lower is better."""
        return -2 * likelihood + (2 * self.mean.size + len(self.mean) - 1) * math.log(documents)


def _rows_of(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(float)


def _sums(features: DataFrame, step) -> np.ndarray | None:
    """Sum of ``step``'s rows (component, values) over all documents; combined in the executors."""
    width = 2 * len(FITTED) + 2
    names = [f"v{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = step(design(_rows_of(batch, 0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), *map(pa.array, total.T)], names=["k", *names])

    schema = "k int, " + ", ".join(f"{n} double" for n in names)
    got = features.select("stats").mapInArrow(run, schema).groupBy("k").agg(*(F.sum(n).alias(n) for n in names)).collect()
    return np.array([r[1:] for r in sorted(got, key=lambda r: r.k)], float) if got else None


def inspected() -> tuple[np.ndarray, list[str]]:
    """Statistics and kinds of the inspected examples."""
    from hypomill.llm.quality_examples import EXAMPLES

    return design([statistics(t) for _, t in EXAMPLES]), [k for k, _ in EXAMPLES]


def fit(features: DataFrame, rounds: int = ROUNDS, last_rounds: int = LAST_ROUNDS) -> Mixture | None:
    """The mixture over all documents, with as many components as the criterion asks for; None without documents.

    The inspected examples are counted among the documents, without their kinds: in a table
    of a few documents there is then something to set them apart from.
    """
    d = len(FITTED)
    examples, _ = inspected()

    def plain(x: np.ndarray) -> np.ndarray:
        return np.hstack([[[0.0, len(x)]], x.sum(0, keepdims=True), (x * x).sum(0, keepdims=True)])

    got = _sums(features, plain)
    if got is None:
        return None
    v = (got + plain(examples))[0]
    documents = v[1]
    center = v[2 : d + 2] / documents
    scale = np.maximum(np.sqrt(np.maximum(v[d + 2 :] / documents - center**2, 0)), 1e-3)
    best: tuple[float, Mixture] | None = None
    model: Mixture | None = Mixture(center, scale, np.ones(1), np.zeros((1, d)), np.ones((1, d)))
    while model is not None:
        last = 2 * len(model.mean) > MOST_COMPONENTS
        before = -math.inf
        score = math.inf
        for _ in range(1 if len(model.mean) == 1 else last_rounds if last else rounds):
            now = model
            sums = _sums(features, now.sums) + now.sums(examples)
            likelihood = sums[0, 0]
            score = min(score, now.criterion(likelihood, documents))
            model = now.moved(sums)
            if last and likelihood - before < CONVERGED * documents:
                break
            before = likelihood
        if best is not None and score >= best[0]:
            break
        best = (score, model)
        model = None if last else model.split(documents)
    return best[1]


def component_kinds(model: Mixture) -> tuple[np.ndarray, list[str]]:
    """[component, kind] shares: the kinds of the inspected examples, by their density under each component."""
    examples, kinds = inspected()
    names = sorted(set(kinds))
    log = model.densities(model.standard(examples)).T.astype(float)
    near = np.exp(log - log.max(1, keepdims=True))
    votes = near @ np.array([[k == n for n in names] for k in kinds], float)
    return votes / votes.sum(1, keepdims=True), names


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, stats array<float>) of every document with text; STATISTICS names the entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                stats = [statistics(t) for t in part.column(1).to_pylist()]
                flat = pa.array([v for row in stats for v in row], pa.float32())
                offsets = pa.array(range(0, len(flat) + 1, len(STATISTICS)), pa.int32())
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "stats"])

    has_text = F.length(F.regexp_replace("text", r"\s+", "")) > 0
    return documents.where(has_text).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<float>")


def classify(documents: DataFrame, rounds: int = ROUNDS, last_rounds: int = LAST_ROUNDS) -> DataFrame:
    """(doc_id, kind, stats) of every document with text; kind is prose, list, table or junk.

    Null, empty and blank texts have no row. A repeated document counts under each doc_id.
    """
    stats = materialize(features(documents), "p9-stats")
    model = fit(stats, rounds, last_rounds)
    if model is None:
        return stats.select("doc_id", F.lit("prose").alias("kind"), "stats")
    shares, names = component_kinds(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r, _ = model.responsibilities(model.standard(design(_rows_of(batch, 1))))
                kind = pa.array([names[k] for k in (r @ shares).argmax(1)])
                yield pa.record_batch([batch.column(0), kind, batch.column(1)], names=["doc_id", "kind", "stats"])

    return stats.mapInArrow(run, "doc_id long, kind string, stats array<float>")


def found(documents: DataFrame) -> DataFrame:
    """p9_found: (doc_id, kind) of every text that is not natural prose."""
    return classify(documents).where("kind <> 'prose'").select("doc_id", "kind")


def plain_statistics(documents: DataFrame) -> DataFrame:
    """Per document: words, mean word length, symbol ratio, share of lines that end in punctuation
    and share of common words, as plain JVM expressions. Every document has a row; a null or
    blank text has 0 words and null shares."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}]+", " "), " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\r]"))
    solid = F.length(F.regexp_replace(text, r"[ \t\r\n]+", ""))
    symbols = F.length(F.regexp_replace(text, r"[\p{L}\p{N} \t\r\n]+", ""))
    common = F.array(*map(F.lit, sorted(w for w in COMMON_WORDS)))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    base = documents.select("doc_id", words.alias("w"), lines.alias("l"), solid.alias("solid"), symbols.alias("symbols"), letters.alias("letters"))

    def share(part, whole):
        return F.when(whole > 0, F.round(part / whole, 6))

    n, k = F.size("w"), F.size("l")
    return base.select(
        "doc_id", n.cast("long").alias("words"), share(F.col("letters"), n).alias("mean_word_length"), share(F.col("symbols"), F.col("solid")).alias("symbol_ratio"),
        share(F.size(F.filter("l", lambda x: x.rlike(r"[.!?…][ \t\r]*$"))), k).alias("line_end_share"),
        share(F.size(F.filter(F.transform("w", F.lower), lambda x: F.array_contains(common, x))), n).alias("common_share"),
    )
