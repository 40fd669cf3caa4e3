"""Request identity and caching of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypomill.functions.jsoncanon import canonical_json_text


def request_sha256(provider: Column, model_id: Column, messages: Column, parameters: Column) -> Column:
    """Hash of what is asked, of whom, and how: equal requests share it whatever the spelling of their parameters.

    Every part is written with its length, so parts cannot run into each other; a missing part
    differs from an empty one.
    """
    def part(c: Column) -> Column:
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))

    said = F.array_join(F.transform(messages, lambda m: F.concat(part(m["role"]), part(m["content"]))), "|")
    settings = F.coalesce(canonical_json_text(parameters), parameters)
    return F.sha2(F.concat_ws("/", part(provider), part(model_id), part(said), part(settings)), 256)


def not_cached(asked: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests that the cache has no answer to."""
    return asked.join(cache.select(key).distinct(), key, "left_anti").select(*asked.columns)


#: Fields of a JSON reply that hold its answer, the first one that is there counting (fixed values).
ANSWER_FIELDS = ("transcript", "corrected", "answer", "text", "rank")


def parse_reply(raw: Column, asked: Column) -> Column:
    """(parser_status, selected_candidate_rank, text) of a stored reply, as plain JVM expressions.

    A reply may stand in a code fence, be a JSON object with one of ANSWER_FIELDS, or be the
    text itself; a lone number (with or without ``rank`` or ``candidate`` before it) selects a
    candidate. ``empty``: nothing is left; ``malformed``: an opened JSON object that does not
    parse or has no answer; ``not_applicable``: nothing was asked. A null reply is empty.
    """
    def bare(c: Column) -> Column:
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    plain = bare(F.regexp_replace(bare(F.coalesce(raw, F.lit(""))), r"^```[a-z]*\n?|\n?```$", ""))
    is_json = plain.startswith("{")
    answer = bare(F.coalesce(*(F.get_json_object(plain, f"$.{f}") for f in ANSWER_FIELDS)))
    text = F.when(is_json, answer).otherwise(plain)
    number = F.regexp_extract(F.lower(text), r"^(?:rank|candidate)? ?#?(\d{1,4})[.)]?$", 1)
    rank = F.when(number != "", number.cast("int"))
    status = (
        F.when(~asked, "not_applicable").when(plain == "", "empty").when(is_json & answer.isNull(), "malformed").when(text == "", "empty").otherwise("parsed"))
    parsed = status == "parsed"
    return F.struct(status.alias("parser_status"), F.when(parsed & (rank > 0), rank).alias("selected_candidate_rank"), F.when(parsed & rank.isNull(), text).alias("text"))
