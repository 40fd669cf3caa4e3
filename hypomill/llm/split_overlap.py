"""Problem 4: the same or nearly the same record on both sides of the training split.

Distinct normalised texts become classes; minwise hashes of each class's word-pair shingles
(a repeated pair is numbered, so they are a multiset) are banded into buckets; only buckets
that an evaluation and a training class share give a candidate. Each candidate is verified by the exact Jaccard similarity of the shingles
(a bound that follows from the allowed edits) and then by the exact edit distance in words.
Word pairs are the shingle because the shortest admitted texts have 8 words: five-word
shingles would leave nothing in common after one edit. Counts and links per row come from
class sizes; only ``overlaps`` expands class pairs, because its result is defined on rows.

Spark takes the size of a written or given table from its compressed files, and that of the
buckets from the texts they are made of; both can be far too low. Joins with such tables are
therefore held to sort and merge: no size that is only guessed sends a table through the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypomill.runtime import SMALL_ROWS, materialize

#: Texts under this many words match by utterance id only.
MIN_WORDS = 8
#: Allowed edits as hundredths of the longer text's word count.
EDIT_PERCENT = 15
#: Minwise hashes: BANDS buckets of ROWS hashes each. The loosest admitted pair (Jaccard 0.52
#: on word pairs) shares a bucket with probability 0.99, a pair with one edit fewer 0.9999.
BANDS, ROWS = 32, 3

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BAND_SALT = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, joined by one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def is_training(split: Column) -> Column:
    return F.coalesce(F.lower(F.trim(split)).startswith("train"), F.lit(False))


def edits_allowed(a: int, b: int) -> int:
    return EDIT_PERCENT * max(a, b) // 100


def band_keys(texts: list[str]) -> np.ndarray:
    """BANDS bucket keys per text, from minwise hashes of its word pairs, repeated ones numbered."""
    hashes: list[np.ndarray] = []
    starts, at, known = [], 0, {}
    for text in texts:
        h = np.empty(text.count(" ") + 1, np.uint64)
        for i, w in enumerate(text.split(" ")):
            v = known.get(w)
            if v is None:
                v = known[w] = zlib.crc32(w.encode()) | zlib.adler32(w.encode()) << 32
            h[i] = v
        pair = h[:-1] * _MIX1 ^ h[1:] * _MIX2
        starts.append(at)
        at += len(pair)
        hashes.append(pair)
    x = np.concatenate(hashes)
    x ^= x >> np.uint64(31)
    # the k-th occurrence of a pair in a text is a shingle of its own
    owner = np.repeat(np.arange(len(texts)), np.diff([*starts, at]))
    order = np.lexsort((x, owner))
    new = np.ones(at, bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (owner[1:] != owner[:-1])  # owner is in order already
    place = np.arange(at)
    x[order] += (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64) * _MIX2
    keys = np.empty((len(texts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(texts), _BAND_SALT[band], np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            y = x * _MULTIPLY[k] + _ADD[k]
            y ^= y >> np.uint64(33)
            key = (key ^ np.minimum.reduceat(y, starts)) * _MIX1
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts, ids = part.column(1).to_pylist(), part.column(0).to_numpy()
            if texts:
                keys = band_keys(texts)
                size = np.array([min(t.count(" ") + 1, 255) for t in texts], np.int64)
                # the id carries the word count, so lengths that can't match part before any text is read
                yield pa.record_batch(
                    [pa.array(keys.ravel()), pa.array(np.repeat(ids * 256 + size, BANDS))], names=["bucket", "tag"]
                )


#: Cells of an alignment band from which it is filled a row at a time.
_CELLS = 20_000


def within_edits(a: list[str], b: list[str], most: int) -> bool:
    """Whether the word edit distance of ``a`` and ``b`` is at most ``most``; only the band of cells that can matter is filled."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    far = most + 1
    if n * (2 * most + 1) > _CELLS:
        ids: dict[str, int] = {}
        x, y = (np.array([ids.setdefault(w, len(ids)) for w in ws]) for ws in (a, b))
        row = np.minimum(np.arange(m + 1), far)
        for i in range(1, n + 1):
            low, high = max(1, i - most), min(m, i + most)
            new = np.minimum(row[low - 1 : high] + (y[low - 1 : high] != x[i - 1]), row[low : high + 1] + 1)
            at = np.arange(low - 1, high + 1)
            first = i if low == 1 else far
            new = np.minimum.accumulate(np.concatenate(([first], new)) - at) + at
            row = np.full(m + 1, far)
            row[low - 1 : high + 1] = np.minimum(new, far)
            if low > 1:
                row[low - 1] = far
            if row.min() > most:
                return False
        return bool(row[m] <= most)
    last = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        low, high = max(1, i - most), min(m, i + most)
        row = [far] * (m + 1)
        row[0] = i if i <= most else far
        least, x = row[0], a[i - 1]
        for j in range(low, high + 1):
            v = last[j - 1] if x == b[j - 1] else 1 + min(last[j - 1], last[j], row[j - 1])
            row[j] = v
            if v < least:
                least = v
        if least > most:
            return False
        last = row
    return last[m] <= most


def verified(a: str, b: str) -> bool:
    """Exact Jaccard of the numbered word pairs against the least value the allowed edits leave, then exact edits."""
    x, y = a.split(" "), b.split(" ")
    most = edits_allowed(len(x), len(y))
    s, t = Counter(zip(x, x[1:])), Counter(zip(y, y[1:]))
    n, m = len(x) - 1, len(y) - 1
    common = sum(min(k, t[p]) for p, k in s.items() if p in t)
    # each edit ends at most two word pairs of the longer text
    least = max(n, m) - 2 * most
    if least > 0 and common * max(1, n + m - least) < least * (n + m - common):
        return False
    return within_edits(x, y, most)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [verified(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


def near_classes(classes: DataFrame) -> DataFrame:
    """(eval_class, train_class) of different texts within the allowed edits.

    ``classes``: class_id bigint, words string, has_train boolean, has_eval boolean; one row
    per distinct text, so a text copied millions of times is one row here.
    """
    def side(flag: str) -> DataFrame:
        return classes.where(flag).select("class_id", "words").mapInArrow(_buckets, "bucket long, tag long")

    e, t = side("has_eval").withColumnRenamed("tag", "e"), side("has_train").withColumnRenamed("tag", "t")
    ne, nt = F.col("e") % 256, F.col("t") % 256
    may = (F.col("e") != F.col("t")) & (
        F.abs(ne - nt) * 100 <= EDIT_PERCENT * F.greatest(ne, nt)) | (F.greatest(ne, nt) == 255)
    pairs = e.join(t.hint("merge"), "bucket").where(may).select(
        F.shiftright("e", 8).alias("eval_class"), F.shiftright("t", 8).alias("train_class")
    ).where("eval_class <> train_class").distinct()
    text = classes.select("class_id", "words")
    return (
        pairs.join(text.toDF("eval_class", "a").hint("merge"), "eval_class")
        .join(text.toDF("train_class", "b").hint("merge"), "train_class")
        .select("eval_class", "train_class", "a", "b")
        .mapInArrow(_verify, "eval_class long, train_class long")
    )


class Overlap:
    """Both sides of a manifest as classes of equal text: membership, and links between classes.

    Nothing here grows with the copies of a text: a text copied a million times is one class,
    and its links are one row each.
    """

    def __init__(self, manifest: DataFrame) -> None:
        self.rows = manifest.select(
            "row_id", "utt_id", "dataset", F.regexp_replace(F.lower(F.trim("split")), "_", "-").alias("split"), is_training(F.col("split")).alias("train"),
            words(F.col("reference_normalized")).alias("words"))
        long = self.rows.where(F.size(F.split("words", " ")) >= MIN_WORDS).withColumn("digest", F.unhex(F.md5("words")))
        classes = materialize(
            long.groupBy("digest", "words").agg(
                F.min("row_id").alias("class_id"), F.max("train").alias("has_train"), F.max(~F.col("train")).alias("has_eval")),
            "p4-classes",
        )
        #: (row_id, utt_id, dataset, split, train, class_id) of every row with a text of MIN_WORDS words.
        self.members = materialize(
            long.drop("class_id").join(classes.select("digest", "words", "class_id").hint("merge"), ["digest", "words"]).select("row_id", "utt_id", "dataset", "split", "train", "class_id"), "p4-members")
        same = classes.where("has_train and has_eval").select(F.col("class_id").alias("eval_class"), F.col("class_id").alias("train_class"))
        #: (eval_class, train_class): equal and near classes across the split.
        self.links = materialize(near_classes(classes).unionByName(same), "p4-links")
        if self.links.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
            self.links = self.links.hint("merge")


def overlaps(manifest: DataFrame) -> DataFrame:
    """(row_a, row_b), row_a < row_b: every cross-split pair by utterance id or by near-same text.

    Null or empty references match nothing, texts under MIN_WORDS words match by id only, a
    null split counts as not training. Repeated rows count singly; every pair appears once.
    """
    o = Overlap(manifest)
    by_id = _across(o.rows.where("utt_id is not null").select("row_id", "train", F.col("utt_id").alias("key")))
    by_text = (
        o.links.join(o.members.where("not train").select(F.col("class_id").alias("eval_class"), F.col("row_id").alias("e")), "eval_class")
        .join(o.members.where("train").select(F.col("class_id").alias("train_class"), F.col("row_id").alias("t")).hint("merge"), "train_class")
        .select(F.least("e", "t").alias("row_a"), F.greatest("e", "t").alias("row_b"))
    )
    return by_id.unionByName(by_text).distinct()


def _across(keyed: DataFrame) -> DataFrame:
    """Pairs of a training and another row with one key."""
    t = keyed.where("train").select("key", F.col("row_id").alias("t"))
    e = keyed.where("not train").select("key", F.col("row_id").alias("e"))
    return e.join(t.hint("merge"), "key").select(F.least("e", "t").alias("row_a"), F.greatest("e", "t").alias("row_b"))


def row_links(manifest: DataFrame) -> DataFrame:
    """(row_id, class_id, links) of every row with a text of MIN_WORDS words: the class of its text (its
    smallest row_id) and how many rows across the split have nearly the same text. No pair is expanded."""
    o = Overlap(manifest)
    sizes = o.members.groupBy("class_id").agg(F.count_if("train").alias("t"), F.count_if(~F.col("train")).alias("e"))
    facing = o.links.join(sizes.select(F.col("class_id").alias("train_class"), "t"), "train_class").join(sizes.select(F.col("class_id").alias("eval_class"), "e"), "eval_class")
    per = facing.select(F.inline(F.array(
        F.struct(F.col("eval_class").alias("class_id"), F.lit(False).alias("train"), F.col("t").alias("n")), F.struct(F.col("train_class").alias("class_id"), F.lit(True).alias("train"), F.col("e").alias("n")))))
    links = per.groupBy("class_id", "train").agg(F.sum("n").alias("links"))
    return o.members.join(links, ["class_id", "train"], "left").select("row_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def overlap_counts(manifest: DataFrame) -> DataFrame:
    """(dataset, split, pairs, rows) of evaluation rows: their pairs with training rows, and how many have one.

    Spellings of one split (case, '_' for '-') count together. Pairs are counted from class
    sizes and never expanded: those by text, plus those by id, less those by both.
    """
    o = Overlap(manifest)
    where = ["dataset", "split"]
    n = F.count(F.lit(1))
    train, evaluation = o.members.where("train"), o.members.where("not train")
    linked = o.links.join(train.groupBy(F.col("class_id").alias("train_class")).agg(n.alias("t")), "train_class")
    by_text = (
        linked.groupBy("eval_class").agg(F.sum("t").alias("t"))
        .join(evaluation.groupBy(F.col("class_id").alias("eval_class"), *where).agg(n.alias("e")), "eval_class").select(*where, (F.col("e") * F.col("t")).alias("pairs"))
    )
    known = o.rows.where("utt_id is not null")
    ids = known.where("train").groupBy("utt_id").agg(n.alias("t"))
    by_id = known.where("not train").groupBy("utt_id", *where).agg(n.alias("e")).join(ids, "utt_id").select(*where, (F.col("e") * F.col("t")).alias("pairs"))
    e_side = evaluation.where("utt_id is not null").groupBy("utt_id", F.col("class_id").alias("eval_class"), *where).agg(n.alias("e"))
    t_side = train.where("utt_id is not null").groupBy("utt_id", F.col("class_id").alias("train_class")).agg(n.alias("t"))
    by_both = e_side.join(o.links, "eval_class").join(t_side, ["utt_id", "train_class"]).select(*where, (-F.col("e") * F.col("t")).alias("pairs"))
    pairs = by_text.unionByName(by_id).unionByName(by_both).groupBy(*where).agg(F.sum("pairs").alias("pairs"))
    # rows with any partner
    has_text = evaluation.join(o.links.select(F.col("eval_class").alias("class_id")).distinct(), "class_id", "left_semi").select("row_id", *where)
    has_id = known.where("not train").join(ids, "utt_id", "left_semi").select("row_id", *where)
    rows = has_text.unionByName(has_id).groupBy(*where).agg(F.countDistinct("row_id").alias("rows"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}")) for c in where]
    return pairs.alias("p").join(rows.alias("r"), same[0] & same[1]).select("p.dataset", "p.split", "pairs", "rows")
