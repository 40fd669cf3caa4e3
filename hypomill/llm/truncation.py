"""Problem 3: stored texts that end before the produced text did, and how often each source cuts.

Per source (ec_system_id or model_id) the lengths of all its texts are fitted by maximum
likelihood as a right-censored log-normal. Every length at which far more texts stop than the
distribution and the neighbouring lengths have there is a candidate limit; each text that
stops at one gets that limit's censoring posterior (against ending there by chance) as prior
odds, any other text the base rate of broken transfers. Findings of its ending - what the
reference or the request still has left, a word cut short, a missing end mark, an unclosed
wrapping, produced tokens that the text is too short for, the unreliable flag - add log-odds.
These weights, and the base rate, are fitted: findings of all texts are counted by pattern,
and a two-class model (cut or whole) is estimated from the counts by expectation-maximization,
begun at the values below.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypomill.llm.broken_pairs import Request, _choice, _lone_label, _most_tokens, _stops_early, left_over, own_share, plain, reply_end, settled, unwrap
from hypomill.runtime import bounded_broadcast, materialize

#: Log-odds of a broken transfer before any evidence, and what each finding adds, where the fit begins.
TRANSFER_PRIOR = -3.5
LEFT_OVER = (-4.0, -2.0, -0.5, 1.0, 2.5, 3.5, 4.8)  # 0, 1, ... 6 or more words left of the reference
SAME_END, CUT_WORD, FRAGMENT, MISHEARD = -8.0, 5.0, 4.0, 1.0
NO_MARK = 5.0  # times the share of the source's texts of this style that have one, squared
WEIGHTS = {
    "flag=yes": 3.0, "flag=no": -0.7, "flag=none": 0.0,
    "end=marked": -7.0, "end=trailing": -6.0,
    **{f"end=unmarked {k}": NO_MARK * (k / 10) ** 2 for k in range(11)}, **{f"end=blank {k}": NO_MARK * (k / 10) ** 2 + 5.0 for k in range(11)},
    "rest=none": 0.0, "rest=same": SAME_END,
    **{f"rest={k}{how}": max(v, 0.0) + CUT_WORD if how == " cut" else v + {"": 0.0, " misheard": MISHEARD, " fragment": FRAGMENT}[how]
       for k, v in enumerate(LEFT_OVER) for how in ("", " cut", " misheard", " fragment")},
    "reply=choice": -4.0, "reply=unclosed": 7.0, "reply=early": 4.0, "reply=late": -7.0, "reply=early short of tokens": 9.0,
    "tokens=limit": 3.0, "tokens=below": 0.0,
}
#: Texts that a beginning value weighs as much as in the fit; iterations of the fit.
BEGUN_WEIGHT, FIT_ROUNDS = 50.0, 20
# Words of one and two letters, and sounds of hesitation.
SHORT_WORDS = frozenset("a i an as at be by do go he if in is it me my no of on or so to up us we ah eh er hm mm oh ok uh um".split())
#: A length is a limit from so many different texts, and so many times what the fit has there and its neighbours have.
LIMIT_TEXTS, LIMIT_TIMES, NEIGHBOURS = 5, 6.0, 5
#: Limits of fields are no shorter than this.
SHORTEST_LIMIT = 12

_FIT = "source string, limits array<struct<length:int,odds:double,last:boolean>>, mark_lower double, mark_title double, mark_upper double, log_ratio double, log_ratio_sd double"


def style(text: Column) -> Column:
    """How a text begins: in capitals throughout, with a capital, or else."""
    s = F.regexp_replace(text, r"[^\p{L}]+", "")
    return F.when((F.length(s) > 3) & (s == F.upper(s)), "upper").when(F.substring(s, 1, 1) != F.lower(F.substring(s, 1, 1)), "title").otherwise("lower")


def ends_marked(text: Column) -> Column:
    return F.coalesce(F.rtrim(text).rlike(r"[.!?…][\"'”»)}`\]]*$"), F.lit(False))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def censored_lognormal(lengths: dict[int, int], limit: int | None, rounds: int = 60) -> tuple[float, float]:
    """Maximum-likelihood (mu, sigma) of log length, texts at ``limit`` or beyond being censored (EM)."""
    exact = [(math.log(n), c) for n, c in lengths.items() if n > 0 and (limit is None or n < limit)]
    hidden = sum(c for n, c in lengths.items() if limit is not None and n >= limit)
    total = sum(c for _, c in exact)
    if not total:
        return (math.log(limit) if limit else 0.0), 1.0
    mu = sum(x * c for x, c in exact) / total
    sigma = max(0.05, math.sqrt(sum((x - mu) ** 2 * c for x, c in exact) / total))
    if not hidden:
        return mu, sigma
    edge = math.log(limit)
    for _ in range(rounds):
        a = (edge - mu) / sigma
        tail = max(1e-12, 1 - normal_cdf(a))
        ratio = math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / tail
        first = mu + sigma * ratio
        second = mu * mu + sigma * sigma + sigma * (edge + mu) * ratio
        n = total + hidden
        mean = (sum(x * c for x, c in exact) + hidden * first) / n
        square = (sum(x * x * c for x, c in exact) + hidden * second) / n
        sigma_new = math.sqrt(max(0.0025, square - mean * mean))
        if abs(mean - mu) + abs(sigma_new - sigma) < 1e-7:
            break
        mu, sigma = mean, sigma_new
    return mu, sigma


def find_limits(lengths: dict[int, int], different: dict[int, float] | None = None) -> list[tuple[int, float, bool]]:
    """(length, log-odds that a text of that length was cut, whether it is the source's last one) of every limit.

    A limit is a length with far more (different) texts than both the fitted distribution and
    the lengths around it have. The last limit, beyond which hardly any text goes, also holds
    for what is longer; any other one only for its very length.
    """
    different = different or lengths
    total = sum(lengths.values())
    beyond, last = 0, None
    for n in sorted(lengths, reverse=True):
        if lengths[n] >= LIMIT_TEXTS and beyond <= 0.1 * lengths[n]:
            last = n
            break
        beyond += lengths[n]
        if beyond > 0.05 * total + LIMIT_TEXTS:
            break
    fits: dict[int | None, tuple[float, float]] = {}
    found = []
    for n in sorted(lengths, reverse=True):
        here = min(float(lengths[n]), different[n])
        if n < SHORTEST_LIMIT or here < LIMIT_TEXTS:
            continue
        limit = n if n == last else None
        if limit not in fits:
            fits[limit] = censored_lognormal(lengths, limit)
        mu, sigma = fits[limit]
        a = (math.log(n) - mu) / sigma
        expected = total * math.exp(-a * a / 2) / (n * sigma * math.sqrt(2 * math.pi))
        # at its very end a distribution has no neighbours on one side
        around = 0.0 if n == last else sum(lengths.get(n + k, 0) for k in range(-NEIGHBOURS, NEIGHBOURS + 1) if k) / (2 * NEIGHBOURS)
        expected = max(expected, around)
        if here >= LIMIT_TIMES * max(expected, 0.2):
            share = 1 - min(0.9, expected / here)
            found.append((n, min(6.0, math.log(share / max(1 - share, 1e-3))), n == last))
    return found


def _fit_source(frame: pd.DataFrame) -> pd.DataFrame:
    """One source's row of _FIT from its counts by (style, marked, length)."""
    by = frame.groupby("length")
    lengths = {int(k): int(v) for k, v in by["n"].sum().items()}
    # texts that fall on each of 64 places by their hash tell the number of different ones
    places = {int(k): int(np.bitwise_or.reduce(v.to_numpy(np.int64))) & (2**64 - 1) for k, v in by["places"]}
    different = {k: -64 * math.log(1 - min(63.5, v.bit_count()) / 64) for k, v in places.items()}
    different = {k: v if v < 200 else float(lengths[k]) for k, v in different.items()}
    limits = [{"length": n, "odds": o, "last": last} for n, o, last in find_limits(lengths, different)]
    marks = []
    for name in ("lower", "title", "upper"):
        own = frame[frame["style"] == name]
        marks.append((own.loc[own["marked"], "n"].sum() + 0.5) / (own["n"].sum() + 2.0))
    with_tokens = frame["n_ratio"].sum()
    mean = frame["sum_ratio"].sum() / with_tokens if with_tokens else None
    sd = math.sqrt(max(1e-4, frame["sum_ratio2"].sum() / with_tokens - mean**2)) if with_tokens else None
    return pd.DataFrame([[frame["source"].iloc[0], limits, *marks, mean, sd]], columns=["source", "limits", "mark_lower", "mark_title", "mark_upper", "log_ratio", "log_ratio_sd"])


def fit_sources(texts: DataFrame) -> DataFrame:
    """Fit every source over all its texts. ``texts``: source, text, tokens (nullable).

    Texts are counted by length before anything is gathered; one task holds the distinct
    lengths of a source, whatever the number of its texts.
    """
    ratio = F.when((F.col("tokens") > 0) & (F.length("text") > 20), F.log(F.col("tokens") / F.length("text")))
    place = F.expr("bit_or(shiftleft(cast(1 as bigint), cast(pmod(xxhash64(text), 64) as int)))")
    counts = (
        texts.where("text is not null and source is not null")
        .groupBy("source", style(F.col("text")).alias("style"), ends_marked(F.col("text")).alias("marked"), F.length("text").alias("length"))
        .agg(F.count(F.lit(1)).alias("n"), place.alias("places"), F.count(ratio).alias("n_ratio"), F.coalesce(F.sum(ratio), F.lit(0.0)).alias("sum_ratio"), F.coalesce(F.sum(ratio * ratio), F.lit(0.0)).alias("sum_ratio2"))
    )
    return bounded_broadcast(counts.groupBy("source").applyInPandas(_fit_source, _FIT), "p3-fits")


def limit_odds() -> Column:
    """The censoring posterior (log-odds) of a ``text`` among its source's ``limits``; null where it stops at none."""
    n = F.length("text")
    at = F.filter("limits", lambda x: (x["length"] == n) | (x["last"] & (x["length"] <= n)))
    return F.array_max(F.transform(at, lambda x: x["odds"]))


def ending(text: str, at_limit: bool, mark_share: float) -> tuple[str, str | None]:
    """What the text alone shows of its end, and its shown part (None: references say nothing more)."""
    shown = text.rstrip()
    dots = shown.endswith(("...", "…"))
    if dots and at_limit:  # the limit's own mark
        shown = shown.rstrip(".…")
    elif dots or shown.endswith(("-", "–", "—")):
        return "end=trailing", None
    if shown[-1:] in (".", "!", "?") and not (at_limit and text.rstrip() != shown):
        return "end=marked", shown
    hanging = text != shown and text[-1:].isspace()
    return f"end={'blank' if hanging else 'unmarked'} {round(10 * mark_share)}", shown


def reference_finding(shown: str, reference: str, at_limit: bool) -> str | None:
    """What one reference shows; None where it or the text has no words. The one of the least beginning weight counts, and ``same`` is the least there is."""
    words, full = plain(shown), plain(reference)
    if not full or not words:
        return None
    if words[-1] == full[-1] and (len(full) < 2 or len(words) < 2 or words[-2] == full[-2] or len(words) >= len(full) - 2):
        return "rest=same"
    _, left, cut = left_over(words, full)
    how = ""
    if cut:
        # the first letters of the very word that follows: by chance only where the word may just be misheard
        missing = len(full[len(full) - left - 1]) - len(words[-1])
        how = " cut" if left or missing > 2 or at_limit else " misheard"
    elif len(words[-1]) <= 2 and words[-1].isalpha() and words[-1] not in SHORT_WORDS and words[-1] not in full:
        how = " fragment"
    return f"rest={min(left, 6)}{how}"


def least_finding(shown: str | None, references: list[str], at_limit: bool, least: str | None = None) -> str:
    """The finding of the reference that the text follows best; ``least``: that of references judged elsewhere."""
    if shown is None:
        return "rest=none"
    found = [f for f in (least, *(reference_finding(shown, r, at_limit) for r in references)) if f is not None]
    return min(found, key=lambda f: (WEIGHTS[f], f), default="rest=none")


def reply_findings(messages, reply: str, tokens: int | None, most_tokens: int | None, at_limit: bool, log_ratio: float | None, log_ratio_sd: float | None) -> tuple[str | None, str, bool]:
    """(finding of the end, of the tokens, short of tokens); no finding of the end: only the terminal-context model tells."""
    content, closed = unwrap(reply)
    words = plain(content)
    if not words or _lone_label.match(content) or _choice.match(content):
        return "reply=choice", "tokens=below", False
    at_tokens = bool(tokens and most_tokens and tokens >= most_tokens)
    token_finding = "tokens=limit" if at_tokens else "tokens=below"
    if not closed:
        return "reply=unclosed", token_finding, False
    request = Request(messages)
    early = _stops_early(content, words, request, own_share(words, request), at_tokens or at_limit)
    short = bool(tokens and log_ratio is not None and len(reply) > 20 and (math.log(tokens / len(reply)) - log_ratio) / max(0.05, log_ratio_sd or 1) > 2.5)
    return None if early is None else "reply=early" if early else "reply=late", token_finding, short


def fitted_weights(patterns: list[tuple[tuple[str, ...], float | None, int]]) -> tuple[float, dict[str, float]]:
    """(base log-odds, weight of each finding) from counts of (findings, limit odds or None, texts).

    Expectation-maximization of a two-class model in which findings of different slots are
    independent within a class. What was seen little stays where it began.
    """
    base = TRANSFER_PRIOR
    count = np.array([n for _, _, n in patterns], float)
    known = np.array([math.nan if o is None else o for _, o, _ in patterns])
    free = np.isnan(known)
    if not len(count) or not (count * free).sum():
        return base, dict(WEIGHTS)
    names = list(WEIGHTS)
    place = {f: i for i, f in enumerate(names)}
    slots = sorted({f.split("=")[0] for f in names})
    slot_of = np.array([slots.index(f.split("=")[0]) for f in names])
    begun = np.array([WEIGHTS[f] for f in names])
    # one row a finding of a pattern
    row = np.repeat(np.arange(len(patterns)), [len(fs) for fs, _, _ in patterns])
    finding = np.array([place[f] for fs, _, _ in patterns for f in fs], np.int64)
    weight = begun.copy()
    for _ in range(FIT_ROUNDS):
        odds = np.where(free, base, np.fmax(known, base)) + np.bincount(row, weight[finding], len(patterns))
        cut = count / (1 + np.exp(-np.clip(odds, -50, 50)))
        is_cut, is_whole = (np.bincount(finding, v[row], len(names)) for v in (cut, count - cut))
        all_cut, all_whole = (np.bincount(slot_of, v, len(slots))[slot_of] for v in (is_cut, is_whole))
        seen = is_cut + is_whole
        fitted = np.log((is_cut + 0.5) / (all_cut + 1)) - np.log((is_whole + 0.5) / (all_whole + 1))
        weight = (seen * fitted + BEGUN_WEIGHT * begun) / (seen + BEGUN_WEIGHT)
        texts = count[free].sum()
        rate = (cut[free].sum() + 0.5) / (texts + 1)
        base = float((texts * math.log(rate / (1 - rate)) + BEGUN_WEIGHT * TRANSFER_PRIOR) / (texts + BEGUN_WEIGHT))
    return base, dict(zip(names, weight.tolist()))


def weighed(rows: DataFrame) -> DataFrame:
    """(record_id, source, odds) of ``rows`` (record_id, source, limit_odds, findings), which are read twice and should be written.

    Patterns are combinations of a fixed list of findings, so their number does not grow with the texts.
    """
    counted = rows.groupBy("findings", F.round("limit_odds", 1).alias("limit_odds")).agg(F.count(F.lit(1)).alias("n")).collect()
    base, weights = fitted_weights([(tuple(r.findings), r.limit_odds, r.n) for r in sorted(counted, key=str)])
    table = F.create_map(*(x for f, w in sorted(weights.items()) for x in (F.lit(f), F.lit(float(w)))))
    total = F.aggregate("findings", F.lit(0.0), lambda t, f: t + F.element_at(table, f))
    return rows.select("record_id", "source", (F.greatest(F.coalesce("limit_odds", F.lit(base)), F.lit(base)) + total).alias("odds"))


def middle_findings(texts: DataFrame, fits: DataFrame, references: DataFrame) -> DataFrame:
    """(utt_id, digest, at_limit, least): the finding of least weight among all ``references`` (utt_id, r) of a text's id.

    Distinct texts meet the references, so rows of one text are one here; the joins can be
    split where an id is hot.
    """
    references = bounded_broadcast(references, "p3-middle")
    different = (
        texts.join(references.select("utt_id").distinct(), "utt_id", "left_semi").join(fits, "source", "left")
        .select("utt_id", "text", limit_odds().isNotNull().alias("at_limit")).distinct()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, at_limit, r in zip(*[c.to_pylist() for c in batch.columns[2:]]):
                shown = ending(text, at_limit, 0.0)[1]
                found.append(None if shown is None else reference_finding(shown, r, at_limit))
            weight = pa.array([None if f is None else WEIGHTS[f] for f in found], pa.float64())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), weight, pa.array(found, pa.string())], names=["utt_id", "digest", "at_limit", "weight", "finding"])

    each = (
        different.join(references, "utt_id").select("utt_id", F.sha2("text", 256).alias("digest"), "text", "at_limit", "r")
        .mapInArrow(run, "utt_id string, digest string, at_limit boolean, weight double, finding string")
    )
    least = F.min_by("finding", F.struct("weight", "finding"))
    return bounded_broadcast(each.where("finding is not null").groupBy("utt_id", "digest", "at_limit").agg(least.alias("least")), "p3-evidence")


def output_rows(outputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(record_id, source, limit_odds, findings) of every recognised text."""
    texts = outputs.select(F.col("output_id").alias("record_id"), "utt_id", F.col("ec_system_id").alias("source"), F.col("output_raw").alias("text"), "truncated").where("text is not null and length(text) > 0")
    fits = fit_sources(texts.select("source", "text", F.lit(None).cast("long").alias("tokens")))
    # an id that is used more than once has more than one reference: the two outermost go with the row, any others are judged apart
    pairs = materialize(
        manifest.where("utt_id is not null").select("utt_id", F.coalesce("reference_raw", "reference_normalized").alias("r")).where("r is not null").distinct(), "p3-references")
    reference = pairs.groupBy("utt_id").agg(F.min("r").alias("r1"), F.max("r").alias("r2"), F.count(F.lit(1)).alias("references"))
    middle = middle_findings(texts, fits, pairs.join(reference.where("references > 2"), "utt_id").where("r <> r1 and r <> r2").select("utt_id", "r"))
    digest = F.when(F.col("references") > 2, F.sha2("text", 256))
    share = F.when(F.col("style") == "upper", F.col("mark_upper")).when(F.col("style") == "title", F.col("mark_title")).otherwise(F.col("mark_lower"))
    joined = (
        texts.withColumn("style", style(F.col("text"))).join(reference, "utt_id", "left").join(fits, "source", "left")
        .withColumn("limit_odds", limit_odds()).withColumns({"digest": digest, "at_limit": F.col("limit_odds").isNotNull()}).join(middle, ["utt_id", "digest", "at_limit"], "left")
        .select("record_id", "source", "limit_odds", "text", "truncated", "r1", "r2", F.coalesce(share, F.lit(0.5)).alias("share"), "least")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            findings = [
                output_findings(text, [r for r in dict.fromkeys((r1, r2)) if r], flag, odds is not None, share, least)
                for odds, text, flag, r1, r2, share, least in zip(*[c.to_pylist() for c in batch.columns[2:]])
            ]
            yield pa.record_batch([*batch.columns[:3], pa.array(findings, pa.list_(pa.string()))], names=["record_id", "source", "limit_odds", "findings"])

    return joined.mapInArrow(run, "record_id long, source string, limit_odds double, findings array<string>")


def output_findings(text: str, references: list[str], flag: bool | None, at_limit: bool, mark_share: float, least: str | None = None) -> list[str]:
    """All findings of one recognised text."""
    end, shown = ending(text, at_limit, mark_share)
    return [f"flag={'none' if flag is None else 'yes' if flag else 'no'}", end, least_finding(shown, references, at_limit, least)]


def outputs_judged(outputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(record_id, source, odds) of every recognised text."""
    return weighed(materialize(output_rows(outputs, manifest), "p3-outputs"))


def replies_judged(exchanges: DataFrame) -> DataFrame:
    """(record_id, source, odds) of every stored reply."""
    texts = exchanges.where("raw_response is not null and length(raw_response) > 0").select(
        F.col("exchange_id").alias("record_id"), F.col("model_id").alias("source"), F.col("raw_response").alias("text"), F.col("output_tokens").alias("tokens"),
        "generation_parameters", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"),
    )
    fits = fit_sources(texts.select("source", "text", "tokens"))
    joined = texts.join(fits, "source", "left").select("record_id", "source", limit_odds().alias("limit_odds"), "messages", "text", "tokens", "generation_parameters", "log_ratio", "log_ratio_sd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                columns = [c.to_pylist() for c in part.columns[2:]]
                found = [reply_findings(m, t, n, _most_tokens(g), odds is not None, r, sd) for odds, m, t, n, g, r, sd in zip(*columns)]
                ends = [reply_end(t, f[0] is None) for t, f in zip(columns[2], found)]
                yield pa.record_batch(
                    [*part.columns[:3], *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.bool_()))), *(pa.array(c, t) for c, t in zip(zip(*ends), (pa.bool_(), pa.bool_(), pa.string())))],
                    names=["record_id", "source", "limit_odds", "end", "tokens", "short", "has_words", "marked", "last_word"])

    schema = "record_id long, source string, limit_odds double, end string, tokens string, short boolean, has_words boolean, marked boolean, last_word string"
    rows = settled(materialize(joined.mapInArrow(run, schema), "p3-replies"), texts.select("text"))
    end = F.coalesce("end", F.when(F.col("early"), "reply=early").otherwise("reply=late"))
    end = F.when((end == "reply=early") & F.col("short"), "reply=early short of tokens").otherwise(end)
    return weighed(rows.select("record_id", "source", "limit_odds", F.array(end, F.col("tokens")).alias("findings")))


def judge(outputs: DataFrame, exchanges: DataFrame, manifest: DataFrame) -> DataFrame:
    """(record_table, record_id, source, odds) of every stored text; odds above 0: more likely cut than not.

    Null and empty texts were not cut. Texts of an unknown source have no limit. A null flag,
    a missing reference or missing token counts add no evidence. Repeated rows count singly.
    """
    return (
        outputs_judged(outputs, manifest).select(F.lit("ec_outputs").alias("record_table"), "record_id", "source", "odds")
        .unionByName(replies_judged(exchanges).select(F.lit("llm_exchanges").alias("record_table"), "record_id", "source", "odds"))
    )


def found(outputs: DataFrame, exchanges: DataFrame, manifest: DataFrame) -> DataFrame:
    """p3_found: (record_table, record_id) of every cut text."""
    return judge(outputs, exchanges, manifest).where("odds > 0").select("record_table", "record_id")


def cut_rates(outputs: DataFrame, exchanges: DataFrame, manifest: DataFrame) -> DataFrame:
    """Texts, cut texts and cut rate per source."""
    return (
        judge(outputs, exchanges, manifest).groupBy("record_table", "source")
        .agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("odds") > 0).alias("cut"))
        .withColumn("cut_rate", F.round(F.col("cut") / F.col("texts"), 6))
    )
