"""Registered queries of the core library, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypomill.functions.alignment import errors, word_edits, word_trace
from hypomill.functions.jsoncanon import canonical_json_text
from hypomill.functions.text import char_tokens, conservative_english, nfkc, word_tokens
from hypomill.operators import diversity, flatten, metrics, nbest, pairs, requests, scoring, selection, validation, voting
from hypomill.runtime import table
from hypomill.sources import jsonl

#: Candidates that diversity and short-list queries ask for; all others take whole lists.
N = 5
EDITS = ("substitutions", "deletions", "insertions", "reference_tokens")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utterance_records")


def _flat_edits(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, *[F.col(f"edits.{e}").alias(e) for e in EDITS])


def _decodable(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of records whose recogniser scores are all there, with a correction score each."""
    rows = selection.finite_scores(nbest.score_table(_records(spark, d)))
    return rows.withColumn("ec_score", nbest.ec_score(F.col("record_id"), F.col("rank")))


# --- text ---------------------------------------------------------------------------------------
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "data_manifest").select("row_id", conservative_english(F.col("reference_raw")).alias("normalized"))


def normalize_unicode(spark: SparkSession, d: str) -> DataFrame:
    text = F.get_json_object("payload", "$.text_raw")
    return table(spark, d, "hypothesis_lines").select("line_id", conservative_english(nfkc(text)).alias("normalized"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "data_manifest").where("reference_raw is not null").select("dataset", conservative_english(F.col("reference_raw")).alias("t"))
    return rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size(word_tokens(F.col("t")))).alias("words"), F.sum(F.size(char_tokens(F.col("t")))).alias("characters"))


def canonical_metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "llm_exchanges").select("exchange_id", canonical_json_text(F.col("generation_parameters")).alias("canonical"))


# --- alignment and error rates ------------------------------------------------------------------
def alignment_counts(spark: SparkSession, d: str) -> DataFrame:
    return _flat_edits(nbest.score_table(_records(spark, d)), "record_id", "rank")


def alignment_trace(spark: SparkSession, d: str) -> DataFrame:
    rows = nbest.candidates(_records(spark, d))
    steps = word_trace(conservative_english(F.col("reference")), conservative_english(F.col("text_raw")))
    return rows.select("record_id", "rank", steps.alias("steps")).select("record_id", "rank", F.posexplode("steps").alias("pos", "step")).select("record_id", "rank", "pos", "step.op", "step.ref", "step.hyp")


def wer_by_system(spark: SparkSession, d: str) -> DataFrame:
    return metrics.baseline(_records(spark, d), "system_id")


def wer_corpus(spark: SparkSession, d: str) -> DataFrame:
    return metrics.baseline(_records(spark, d))


def cer_by_system(spark: SparkSession, d: str) -> DataFrame:
    return metrics.baseline(_records(spark, d), "system_id", unit="char")


def line_wer_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """Error rate of N-best lines by rank against the manifest's reference of their utterance.

    An id with several references has the first in order. Lines of ids that no manifest row
    has (one open channel holds a tenth of them) meet no reference and are counted apart.
    """
    lines = jsonl.nbest_lines(table(spark, d, "hypothesis_lines")).where("not broken and utt_id is not null")
    refs = table(spark, d, "data_manifest").where("utt_id is not null and reference_raw is not null").groupBy("utt_id").agg(F.min("reference_raw").alias("reference"))
    rows = lines.select("utt_id", "rank", conservative_english(F.col("text_raw")).alias("hyp")).join(refs, "utt_id", "left")
    scored = rows.withColumn("edits", word_edits(conservative_english(F.col("reference")), F.col("hyp")))
    return metrics.corpus_metrics(scored, "rank", also=[F.count_if(F.col("reference").isNull()).alias("without_reference")])


def correction_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What each correction system did to the recogniser's first candidate of the same utterance."""
    o = table(spark, d, "ec_outputs").select("output_id", "utt_id", "ec_system_id", conservative_english(F.col("output_raw")).alias("after"))
    first = nbest.candidates(_records(spark, d)).where("rank = 1 and utt_id is not null").groupBy("utt_id").agg(F.min_by(F.struct("reference", "text_raw"), "record_id").alias("b"))
    first = first.select("utt_id", conservative_english(F.col("b.reference")).alias("ref"), conservative_english(F.col("b.text_raw")).alias("before"))
    # outputs of utterances that no record has are counted apart
    rows = o.join(first, "utt_id", "left")
    return metrics.correction_diagnostics(rows, "ref", "before", "after", "ec_system_id", also=[F.count_if(F.col("ref").isNull()).alias("without_record")])


def output_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length of corrected texts against references, empty ones and those flagged as truncated, per system."""
    refs = table(spark, d, "data_manifest").where("utt_id is not null and reference_raw is not null").groupBy("utt_id").agg(F.min("reference_raw").alias("reference"))
    rows = table(spark, d, "ec_outputs").select("utt_id", "ec_system_id", "truncated", "output_raw").join(refs, "utt_id", "left")
    h = F.size(word_tokens(conservative_english(F.coalesce("output_raw", F.lit("")))))
    r = F.size(word_tokens(conservative_english(F.col("reference"))))
    total = rows.select("ec_system_id", "truncated", h.alias("h"), F.when(F.col("reference").isNotNull(), r).alias("r")).groupBy("ec_system_id").agg(
        F.count(F.lit(1)).alias("outputs"), F.count_if(F.col("h") == 0).alias("empty"), F.count_if("truncated").alias("truncated"),
        F.coalesce(F.sum(F.when(F.col("r").isNotNull(), F.col("h"))), F.lit(0)).alias("output_words"), F.coalesce(F.sum("r"), F.lit(0)).alias("reference_words"))
    return total.withColumn("ratio", F.when(F.col("reference_words") > 0, F.col("output_words") / F.col("reference_words")))


def werr_by_system(spark: SparkSession, d: str) -> DataFrame:
    """Relative reduction of the oracle over the first candidate, per recogniser."""
    per = _first_and_oracle(spark, d)
    tokens, before, after = F.sum("a.reference_tokens"), F.sum(errors(F.col("a"))), F.sum(errors(F.col("b")))
    both = per.groupBy("system_id").agg(metrics.error_rate(before, tokens).alias("baseline"), metrics.error_rate(after, tokens).alias("oracle"))
    return both.withColumn("werr", metrics.relative_reduction(F.col("baseline"), F.col("oracle")))


# --- oracle and diversity -----------------------------------------------------------------------
def oracle_selection(spark: SparkSession, d: str) -> DataFrame:
    return _flat_edits(selection.oracle_selection(nbest.score_table(_records(spark, d))), "record_id", "rank", "text_raw")


def oracle_by_n(spark: SparkSession, d: str) -> DataFrame:
    return selection.oracle_by_n(nbest.score_table(_records(spark, d)))


def average_unique(spark: SparkSession, d: str) -> DataFrame:
    return diversity.averages(diversity.unique_texts(_records(spark, d), N), "system_id")


def cross_wer(spark: SparkSession, d: str) -> DataFrame:
    return diversity.cross_error_rate(diversity.unique_texts(_records(spark, d), N), "system_id")


def nbest_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return diversity.evaluate(_records(spark, d), N)


def prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    lists = nbest.nbest_lists(_records(spark, d))
    return lists.select("record_id", F.size("hypotheses").alias("n"), F.size(F.slice("hypotheses", 1, 3)).alias("first_three"))


# --- decoding -----------------------------------------------------------------------------------
def constrained_decode(spark: SparkSession, d: str) -> DataFrame:
    chosen = selection.constrained(_decodable(spark, d), F.lit(0.5))
    return chosen.select("record_id", "rank", "text_raw", "ec_score", "sequence_logscore", F.round("combined_score", 9).alias("combined_score"))


def lambda_curve(spark: SparkSession, d: str) -> DataFrame:
    return selection.weight_curve(_decodable(spark, d))


def lambda_select(spark: SparkSession, d: str) -> DataFrame:
    return selection.select_weight(selection.weight_curve(_decodable(spark, d)))


def closest_projection(spark: SparkSession, d: str) -> DataFrame:
    """The candidate nearest to a free correction; the correction here is the list's last candidate."""
    rows = _decodable(spark, d)
    last = rows.groupBy("record_id").agg(F.max_by("hyp", "rank").alias("generated"))
    return selection.closest(rows.join(last, "record_id"), "generated")


def unconstrained_outputs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "ec_outputs").where("decoding_strategy = 'unconstrained'").withColumnRenamed("output_id", "record_id").select("record_id", F.col("output_raw").alias("generated"))
    return selection.unconstrained(o, "generated", conservative_english)


def _beams(spark: SparkSession, d: str) -> DataFrame:
    return nbest.candidates(_records(spark, d), with_tokens=True).select("record_id", F.col("rank").alias("original_index"), "tokens", F.col("sequence_logscore").alias("sum_logprob"))


def _ranked(spark: SparkSession, d: str, penalty: float | None) -> DataFrame:
    return selection.rank_candidates(_beams(spark, d), "record_id", penalty).select("record_id", "original_index", F.round("ranking_score", 9).alias("ranking_score"), "rank")


def undecodable_lists(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose list cannot be decoded, with what is wrong with their score."""
    return selection.undecodable(nbest.candidates(_records(spark, d)))


def unrankable_beams(spark: SparkSession, d: str) -> DataFrame:
    return selection.unrankable(_beams(spark, d), "record_id")


def rank_by_length(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, None)


def rank_by_penalty(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, 0.6)


def sequence_logprob(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as logits of a 64-word vocabulary, their labels as labels, 20 steps an item."""
    steps = table(spark, d, "embeddings").select(F.expr("vec_id div 20").alias("item"), F.col("embedding").alias("logits"), F.when(F.col("vec_id") % 7 == 0, scoring.IGNORED).otherwise(F.col("label")).alias("label"))
    got = scoring.sequence_logprobs(steps)
    return got.select("item", "token_count", F.round("logprob_sum", 6).alias("logprob_sum"), F.round("logprob_mean", 6).alias("logprob_mean"))


# --- training pairs -----------------------------------------------------------------------------
def _serialized(name: str, order: str = "rank") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: pairs.serialized(_records(spark, d), pairs.SERIALIZERS[name], None, order)


def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.training_pairs(_records(spark, d), pairs.SERIALIZERS["literal-sep@v1"], 3)


def tagged_prompts(spark: SparkSession, d: str) -> DataFrame:
    return pairs.serialized(_records(spark, d), pairs.TaggedSerializer("tagged@v1"))


def error_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs.filter_by_error(nbest.score_table(_records(spark, d)))
    return rows.groupBy("dataset", "kept").agg(F.count(F.lit(1)).alias("pairs"), F.sum(errors(F.col("edits"))).alias("errors"))


def length_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Length of first candidates against references, and empty ones, per recogniser."""
    rows = nbest.candidates(_records(spark, d)).where("rank = 1")
    sizes = rows.select("system_id", F.size(word_tokens(conservative_english(F.col("reference")))).alias("r"), F.size(word_tokens(conservative_english(F.col("text_raw")))).alias("h"))
    total = sizes.groupBy("system_id").agg(F.sum("h").alias("hypothesis_words"), F.sum("r").alias("reference_words"), F.count_if(F.col("h") == 0).alias("empty"))
    return total.withColumn("ratio", F.when(F.col("reference_words") > 0, F.col("hypothesis_words") / F.col("reference_words")))


def combined_lists(spark: SparkSession, d: str) -> DataFrame:
    return pairs.combined_lists(_records(spark, d))


def _first_and_oracle(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, system_id, a, b): edits of each list's first and best candidate, from one pass over the lists."""
    return selection.first_and_best(nbest.score_table(_records(spark, d)))


def win_loss(spark: SparkSession, d: str) -> DataFrame:
    return selection.loss_and_win(_first_and_oracle(spark, d), "b", "a", "system_id")


def bootstrap_difference(spark: SparkSession, d: str) -> DataFrame:
    return selection.bootstrap(_first_and_oracle(spark, d), "a", "b")


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return selection.bootstrap_interval(selection.bootstrap(_first_and_oracle(spark, d), "a", "b"))


# --- validation, joins and sets -----------------------------------------------------------------
def utterance_violations(spark: SparkSession, d: str) -> DataFrame:
    return validation.violation_counts(_records(spark, d), validation.utterance_rules())


def candidate_violations(spark: SparkSession, d: str) -> DataFrame:
    return validation.violation_counts(_records(spark, d), validation.candidate_rules())


def short_lists(spark: SparkSession, d: str) -> DataFrame:
    return validation.short_lists(_records(spark, d), N)


def voted_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text that the candidates of each list vote for, word by word, with its edit counts."""
    lists = nbest.nbest_lists(_records(spark, d)).select("record_id", "reference", F.transform("hypotheses", lambda h: conservative_english(h["text_raw"])).alias("texts"))
    voted = lists.withColumn("voted", voting.vote(F.col("texts")))
    return _flat_edits(voted.withColumn("edits", word_edits(conservative_english(F.col("reference")), F.col("voted"))), "record_id", "voted")


def request_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Different requests by the hash of what was asked, with the exchanges that ask it."""
    e = table(spark, d, "llm_exchanges")
    return e.groupBy(requests.request_sha256(F.col("provider"), F.col("model_id"), F.col("messages"), F.col("generation_parameters")).alias("request")).agg(F.count(F.lit(1)).alias("exchanges"), F.min("exchange_id").alias("first_exchange"))


def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """What each stored reply parses to: its status, and a candidate's rank or a transcript."""
    parsed = requests.parse_reply(F.col("raw_response"), F.size("messages") > 0)
    return table(spark, d, "llm_exchanges").select("exchange_id", parsed.alias("p")).select("exchange_id", "p.*")


def unanswered_requests(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges whose request no exchange with a reply answers: what a cache would still have to ask."""
    e = table(spark, d, "llm_exchanges").select("exchange_id", "request_hash", "raw_response")
    return requests.not_cached(e.select("exchange_id", "request_hash"), e.where("raw_response is not null"), "request_hash")


def normalized_curve(spark: SparkSession, d: str) -> DataFrame:
    """The weight curve over scores standardised within each list."""
    return selection.weight_curve(selection.standardized(_decodable(spark, d), "sequence_logscore", "ec_score"))


def output_violations(spark: SparkSession, d: str) -> DataFrame:
    return validation.violation_counts(table(spark, d, "ec_outputs"), validation.output_rules())


def exchange_violations(spark: SparkSession, d: str) -> DataFrame:
    return validation.violation_counts(table(spark, d, "llm_exchanges"), validation.exchange_rules())


def manifest_violations(spark: SparkSession, d: str) -> DataFrame:
    return validation.violation_counts(table(spark, d, "data_manifest"), validation.manifest_rules())


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return validation.repeated(table(spark, d, "data_manifest"), "utt_id")


def duplicate_audio(spark: SparkSession, d: str) -> DataFrame:
    return validation.repeated(table(spark, d, "data_manifest"), "audio_path")


def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    return validation.in_several_splits(table(spark, d, "data_manifest"))


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "data_manifest").groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("utt_id").alias("utterances"))


def rank_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", pairs.ranks_in_order(F.col("asr.hypotheses")).alias("in_order"))


def score_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of lists that correction outputs never chose, and chosen ranks that no list has."""
    c = nbest.candidates(_records(spark, d)).where("utt_id is not null").select(F.col("utt_id").alias("record_id"), "rank").distinct()
    s = table(spark, d, "ec_outputs").where("utt_id is not null and selected_candidate_rank is not null").select(F.col("utt_id").alias("record_id"), F.col("selected_candidate_rank").alias("rank")).distinct()
    return selection.score_coverage(c, s).withColumnRenamed("record_id", "utt_id")


def normalizer_consensus(spark: SparkSession, d: str) -> DataFrame:
    return validation.normalizer_consensus(_records(spark, d))


def requested_n(spark: SparkSession, d: str) -> DataFrame:
    return validation.requested_n(_records(spark, d), "record_id")


def parse_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = jsonl.nbest_lines(table(spark, d, "hypothesis_lines"))
    return lines.groupBy("source_system_id", "score_type").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("broken").alias("broken"), F.countDistinct("utt_id").alias("utterances"), F.max("rank").alias("deepest_rank"))


def missing_utterances(spark: SparkSession, d: str) -> DataFrame:
    """Utterances of N-best lines that no manifest row has."""
    lines = table(spark, d, "hypothesis_lines").groupBy("utt_id").agg(F.count(F.lit(1)).alias("lines"))
    return lines.join(table(spark, d, "data_manifest").select("utt_id"), "utt_id", "left_anti")


def exchange_messages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "llm_exchanges").select("exchange_id", F.posexplode("messages").alias("pos", "m"))
    return e.select("exchange_id", "pos", "m.role", F.length("m.content").alias("characters"))


def request_cache(spark: SparkSession, d: str) -> DataFrame:
    """Requests answered more than once from the cache: first exchange and number of replies."""
    e = table(spark, d, "llm_exchanges").where("request_hash is not null")
    return e.groupBy("request_hash").agg(F.min("exchange_id").alias("first_exchange"), F.count(F.lit(1)).alias("replies"), F.countDistinct("raw_response").alias("texts")).where("replies > 1")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.found(_records(spark, d))


def p6_words(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of segment words with their texts and probabilities."""
    return flatten.words(_records(spark, d)).drop("node")


def p6_logprobs(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of token log-probabilities."""
    return flatten.logprobs(_records(spark, d))


def p6_word_links(spark: SparkSession, d: str) -> DataFrame:
    """Words and their summed probability in thousandths per hypothesis, linked by interval containment."""
    nodes = flatten.interval_nodes(_records(spark, d))
    linked = flatten.contained(flatten.flat_table(nodes, "word"), flatten.flat_table(nodes, "hypothesis"))
    return linked.groupBy("record_id", F.col("up_hyp_pos").alias("hyp_pos")).agg(F.count(F.lit(1)).alias("words"), F.sum(F.round(F.col("number") * 1000).cast("long")).alias("thousandths"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        normalize_text, normalize_unicode, token_counts, canonical_metadata, alignment_counts, alignment_trace, wer_by_system, wer_corpus, cer_by_system,
        line_wer_by_rank, correction_diagnostics, output_lengths, werr_by_system, oracle_selection, oracle_by_n, average_unique, cross_wer, nbest_evaluation, prefix_counts,
        constrained_decode, lambda_curve, lambda_select, closest_projection, unconstrained_outputs, rank_by_length, rank_by_penalty, sequence_logprob,
        training_pairs, tagged_prompts, error_filter, length_ratio, combined_lists, win_loss, bootstrap_difference, bootstrap_interval, undecodable_lists, unrankable_beams,
        utterance_violations, candidate_violations, short_lists, voted_texts, request_hashes, parsed_replies, unanswered_requests, normalized_curve, output_violations, exchange_violations, manifest_violations, duplicate_ids, duplicate_audio, split_overlap, manifest_counts,
        rank_contiguity, score_coverage, normalizer_consensus, requested_n, parse_lines, missing_utterances, exchange_messages, request_cache,
        p6_found, p6_words, p6_logprobs, p6_word_links,
    )
} | {
    "serialize_literal": _serialized("literal-sep@v1"),
    "serialize_special": _serialized("added-special-sep@v1"),
    "serialize_sentinel": _serialized("t5-sentinel@v1"),
    "order_reversed": _serialized("literal-sep@v1", "reversed"),
    "order_sorted": _serialized("literal-sep@v1", "sorted"),
    "order_shuffled": _serialized("literal-sep@v1", "shuffled"),
}
