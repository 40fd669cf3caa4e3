"""Problem 2: prompt and response pairs whose response is defective, with the defect.

A reply is first freed of its wrapping (code fence, JSON field, quotes, label). Copies are found
by compression: the request's parts are compressed with the reply as zstandard dictionary (a
part that the reply holds costs next to nothing), and the reply with the request as dictionary
tells how much of it is the request's own words. Of replies that are not made of the request's
words, a dictionary of refusal cues - who speaks, what is denied, what it is about - tells the
refusals, and script and function words tell another language, also one that no list knows:
its texts hold hardly a function word of the language asked for. A terminal-context model -
what still follows, in the request, on the words with which the reply ends, and where the
request says nothing, how often that word ends a text and that source marks an end - decides
truncation.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypomill.runtime import bounded_broadcast, materialize

#: Share of a part that the reply explains, from which the part counts as given back.
INSTRUCTION_SHARE, PASSAGE_SHARE, QUOTED_PASSAGE_SHARE = 0.5, 0.3, 0.8
#: A reply of so many times a candidate's words holds more than one candidate.
LIST_RATIO = 1.5
#: Share of the reply explained by the request from which its words are the request's own.
OWN_WORDS = 0.5
#: Share below which next to nothing of it is.
UNKNOWN_WORDS = 0.3
#: Replies of so few words are too short for compression; their words are looked up instead.
SHORT_REPLY = 6

# Replies without content.
NO_CONTENT = frozenset(
    "none null nil n/a na nan undefined empty <empty> [empty] <none> [none] [] {} ... … - -- . no answer no response no output "
    "blank <blank> [blank] silence [silence]".split() + ["no answer", "no response", "no output"]
)
# Function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or but of to in on at by for with from as is was are this that these those it its his her their our "
          "each every some any another when while because although until before after since whereas so under over near above "
          "below behind beside between through along across around against among beneath beyond inside outside past toward within "
          "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen twenty thirty forty fifty sixty "
          "seventy eighty ninety last next ago".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht mit von zu im am auf für ist war als auch "
          "sich weil denn wenn obwohl während sobald nach vor hinter unter neben gegen ohne ich kann dabei".split(),
    "fr": "le la les un une des du de et ou mais ne pas avec pour dans sur sans au aux en est que qui car puisque quand pendant "
          "avant après derrière sous comme lorsque je vous l d".split(),
    "es": "el la los las un una unos unas de del y o pero con por para al en es que porque aunque cuando mientras sin antes "
          "después detrás bajo hacia junto lo se pues".split(),
}
# Word endings that set apart languages with common function words.
_endings = {"fr": re.compile(r"(?:ait|aient|eux|eau|eille|elle|ette|oire?|onne|que)$"), "es": re.compile(r"(?:aba|aban|ía|ción|dad|illo|illa|ero|aje|ó)$")}
_languages: dict[str, list[str]] = {}
for _name, _list in FUNCTION_WORDS.items():
    for _w in _list:
        _languages.setdefault(_w, []).append(_name)

# Cues of declining replies, as whole words or, with a star, as beginnings of words.
REFUSAL_CUES = {
    # who speaks, or whose rules
    "self": "i i'm i'd i'll i've me my mine myself we're ai assistant model ich mir mich mein* wir unser* je j moi mon ma mes nous notre nos yo me mi mis nosotros "
            "nuestr* estoy tengo puedo ik mij mijn wij onze io mio sono posso eu meu minha estou jag min vi vår",
    # what is denied
    "denied": "stop* not n't cannot can't won't don't couldn't wouldn't shouldn't isn't never no none nothing unable unwilling declin* refus* reject* rather prefer* sorry apolog* regret* unfortunately afraid "
              "nicht kein* niemals leider ablehn* verweiger* bedauer* ne n pas refuse* refuser désolé* malheureusement regrette* impossible ningun* niet geen helaas non não purtroppo spiacente infelizmente "
              "lamento lamentablemente siento negarme rechaz* inte tyvärr",
    # what it is about
    "task": "help* assist* comply provid* process* answer* respond* complet* perform* fulfil* continu* proceed* discuss* engage* giv* request* task* instruction* able comfortable "
            "helfen weiterhelfen antwort* beantwort* bearbeit* anfrage* aufgabe* aid* répond* trait* demande* tâche* fournir "
            "ayud* proces* respond* solicitud* tarea* realizar helpen beantwoorden verzoek aiut* rispond* ajud* hjälp*",
    # by what rule; two of these are enough
    "rule": "polic* guideline* permi* allow* authori* appropriate inappropriate remit scope violat* prohibit* restrict* unsafe responsib* abilit* capab* possible safety consent confidential* private privacy copyright* "
            "erlaub* darf dürfen richtlinie* möglich zulässig befugt autoris* droit règle* mesure autoriz* posible norma* polític* capaz toegestaan beleid consentit* permitid* tillåt*",
}
_cues: dict[str, set[str]] = {}
_cue_starts: list[tuple[str, str]] = []
for _kind, _listed in REFUSAL_CUES.items():
    for _w in _listed.split():
        if _w.endswith("*"):
            _cue_starts.append((_w[:-1], _kind))
        else:
            _cues.setdefault(_w, set()).add(_kind)
_starts = re.compile("(?:" + "|".join(sorted((re.escape(w) for w, _ in _cue_starts), key=len, reverse=True)) + ")")
_kind_of_start = dict(_cue_starts)
#: Share of words that are cues from which a text of two kinds of cues declines.
CUE_SHARE = 0.16


_word = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_cue_word = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_foreign_script = re.compile(r"[^\W\d_\u0000-\u024f\u1e00-\u1eff]")
_plain = re.compile(r"[^\W_]+")
_label = re.compile(
    r"^(?:(?:corrected |final )?(?:transcript(?:ion)?|answer|text|result|summary|output|antwort|transkript|réponse|respuesta)|"
    r"candidate \d+|here is (?:the )?(?:result|answer|transcript|summary)|(?:sure|ok|okay|hmm|certainly|task|well|of course))\s*[:.,!]\s+", re.I)
_lone_label = re.compile(r"^(?:(?:corrected |final )?(?:transcript(?:ion)?|answer|text|result|summary|output)|here is (?:the )?(?:result|answer|transcript|summary))\s*:?$", re.I)
_choice = re.compile(r"^(?:rank|candidate|hypothesis|option|number|no|nr|rang|numéro|número|kandidat|candidat|candidato)?[.:# ]*\d{1,4}[.):]?$", re.I)
_candidate = re.compile(r"^\s*(?:\(?\d{1,3}[.):]|#\d+|\[\d+\]|[-•*])\s+(?=\S)")
_unfinished_json = re.compile(r'^[{\[]\s*"?\w*"?\s*:?\s*"?')

_coder = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
_FRAME = 8  # bytes of an empty frame, about


def explained(text: str, source: str) -> float:
    """Share of ``text`` that is known from ``source``: 1 - size with it as dictionary / size alone."""
    if not text:
        return 0.0
    raw = text.encode("utf-8", "replace")
    alone = max(1, len(_coder.compress(raw)) - _FRAME)
    known = source.encode("utf-8", "replace")
    if len(known) < 8:  # no dictionary is as short
        return 0.0
    dictionary = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    coder = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
    return 1 - max(0, len(coder.compress(raw)) - _FRAME) / alone


def declines(content: str) -> bool:
    """Does a text speak of itself and of what it will not or may not do?

    It holds cues of two kinds (or two of rules), and cues are no small part of its first
    sentence or of all of it.
    """
    def cues(text: str) -> tuple[int, int, int]:
        kinds: Counter = Counter()
        words, hits = _cue_word.findall(text), 0
        for w in words:
            own = _cues.get(w, set())
            if not own and w.endswith("n't"):
                own = {"denied"}
            if not own and (m := _starts.match(w)):
                own = {_kind_of_start[m[0]]}
            hits += bool(own)
            kinds.update(own)
        return len(kinds) + (kinds["rule"] > 1), hits, len(words)

    text = content.lower().replace("’", "'")
    for part in (re.split(r"(?<=[.!?])\s", text, maxsplit=1)[0], text):
        kinds, hits, words = cues(part)
        if kinds > 1 and hits >= CUE_SHARE * words:
            return True
    return False


def unwrap(reply: str) -> tuple[str, bool]:
    """A reply's content without its wrapping, and whether the wrapping is closed."""
    s, closed = reply.replace("​", "").replace("﻿", "").strip(), True
    while True:  # every layer taken off makes it shorter
        before = s
        if s.startswith("```"):
            body = re.sub(r"^```\w*\n?", "", s)
            if body.rstrip().endswith("```"):
                body = body.rstrip()[:-3]
            elif "```" not in body:
                closed = False
            s = body.strip()
        elif s.startswith("{") or s.startswith("["):
            try:
                value = json.loads(s)
            except ValueError:
                if s.startswith("{") and re.match(r'^\{\s*"', s):
                    if not s.rstrip().endswith("}"):
                        closed = False
                    s = _unfinished_json.sub("", s, count=1).rstrip()
                    s = re.sub(r'"\s*\}?$', "", s)
            else:
                s = "\n".join(_told(value)).strip()
        elif s[:1] in "\"“«" and s[:1]:
            pair = {'"': '"', "“": "”", "«": "»"}[s[0]]
            if len(s) > 1 and s.endswith(pair):
                s = s[1:-1].strip()
            elif s.count(s[0]) == 1 and pair not in s[1:]:
                closed = False
                s = s[1:].strip()
        else:
            s = _label.sub("", s, count=1).strip()
        if len(s) >= len(before):
            break
    return s, closed


def _told(value) -> list[str]:
    """What a JSON reply tells: all its texts, in order; without any, its numbers."""
    texts: list[str] = []
    other: list[str] = []
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, (dict, list)):
            todo += reversed(x.values() if isinstance(x, dict) else x)
        elif isinstance(x, str):
            texts.append(x)
        elif x is not None:
            other.append(str(x))
    return texts or other


def plain(text: str) -> list[str]:
    return _plain.findall(text.lower())


def language_scores(text: str) -> dict[str, float]:
    """Function words of each language in a text; letters and endings of its own weigh in."""
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in _plain.findall(text.lower()):
        for name in _languages.get(w, ()):
            score[name] += 1
        for name, ending in _endings.items():
            if ending.search(w):
                score[name] += 0.5
    if any(c in text for c in "äöüßÄÖÜ"):
        score["de"] += 1
    if any(c in text for c in "ñ¿¡áíóúÁÍÓÚ"):
        score["es"] += 1
    if any(c in text for c in "èêàâçùîôœ"):
        score["fr"] += 1
    return score


class Request:
    """A request's parts: its instruction, its candidates or its passage."""

    def __init__(self, messages: list[dict] | None) -> None:
        said = [m["content"] for m in messages or () if m and m.get("content") and m.get("role") != "assistant"]
        users = [m["content"] for m in messages or () if m and m.get("content") and m.get("role") == "user"] or said
        self.text = "\n\n".join(users)
        self.everything = "\n\n".join(said)
        self.candidates: list[list[str]] = []
        blocks, rest = re.split(r"\n\s*\n", self.text), []
        for block in blocks:
            lines = [x for x in block.split("\n") if x.strip()]
            if lines and all(_candidate.match(x) for x in lines):
                self.candidates += [plain(_candidate.sub("", x)) for x in lines]
            elif block.strip():
                rest.append(block)
        self.instruction = self.passage = ""
        if self.candidates:
            self.instruction = " ".join(rest)
        elif len(rest) > 1:
            # the passage is the longer part, wherever it stands
            k = max(range(len(rest)), key=lambda i: len(rest[i]))
            self.passage = rest[k]
            self.instruction = " ".join(rest[:k] + rest[k + 1 :])
        else:
            self.instruction = " ".join(rest)
        self.question = "?" in self.instruction
        self.sentences = [plain(x) for x in re.split(r"(?<=[.!?])\s+", self.passage) if x.strip()]


#: Cells of an alignment table from which it is filled a row at a time.
_CELLS = 20_000


def left_over(reply: list[str], text: list[str]) -> tuple[int, int, bool]:
    """Align a reply with the start of a text: (edits, words left of the text, last word cut short)."""
    last = list(range(len(text) + 1))
    if len(reply) * len(text) > _CELLS:
        ids: dict[str, int] = {}
        x, y = (np.array([ids.setdefault(w, len(ids)) for w in ws]) for ws in (reply, text))
        row, at = np.array(last), np.arange(len(text) + 1)
        for i, w in enumerate(x, 1):
            new = np.minimum(row[:-1] + (y != w), row[1:] + 1)
            # insertions: the least of what stands further left, a word dearer each
            row = np.minimum.accumulate(np.concatenate(([i], new)) - at) + at
        last = row.tolist()
    else:
        for i, w in enumerate(reply, 1):
            row = [i]
            for j, v in enumerate(text, 1):
                row.append(min(last[j - 1] + (w != v), last[j] + 1, row[j - 1] + 1))
            last = row
    best = (len(reply), len(text), False)
    for j in range(len(text), -1, -1):
        cut = bool(j) and bool(reply) and reply[-1] != text[j - 1] and len(reply[-1]) < len(text[j - 1]) and text[j - 1].startswith(reply[-1])
        cost = last[j] - cut
        if cost < best[0] or (cost == best[0] and cut and not best[2] and j >= len(text) - best[1]):
            best = (cost, len(text) - j, cut)
    return best


#: A word that ends fewer of its occurrences than this does not end a text.
RARE_END = 0.01
#: Share of a source's replies with an end mark from which a missing one tells.
SETS_MARKS = 0.5
#: Words that a task counts before it passes them on.
HELD_WORDS = 100_000


def word_ends(replies: DataFrame) -> DataFrame:
    """(word, seen, ended): how often each word occurs and ends a marked text, over all replies. ``replies``: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        ended: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([ended[w] for w in seen], pa.int64())], names=["word", "seen", "ended"])
            seen.clear()
            ended.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                content, closed = unwrap(text)
                words = plain(content)
                seen.update(words)
                if words and closed and _end_mark(content):
                    ended[words[-1]] += 1
                if len(seen) > HELD_WORDS:
                    yield told()
        yield told()

    counts = replies.where("text is not null").select("text").mapInArrow(run, "word string, seen long, ended long")
    return counts.groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))


def settled(judged: DataFrame, replies: DataFrame) -> DataFrame:
    """Adds ``early`` to ``judged`` rows (source, has_words, marked, last_word, ...): whether a reply whose
    request says nothing of its end (last_word is not null) stops early; null for all others.

    It does if its source marks most ends, or if its last word hardly ever ends a text. Ends are
    counted over all replies, words and sources by themselves. Words are counted only where a
    source without marks leaves replies open. ``judged`` is read more than once and should be written.
    """
    marks = judged.where("has_words").groupBy("source").agg(((F.count_if("marked") + 2.0) / (F.count(F.lit(1)) + 2.0) >= SETS_MARKS).alias("sets_marks"))
    marks = bounded_broadcast(marks.select(F.col("source").alias("_source"), "sets_marks"), "p2-marks")
    known = judged.join(marks, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    asked = F.col("last_word").isNotNull()
    open_ = asked & ~F.coalesce("sets_marks", F.lit(False))
    early = F.when(asked, F.coalesce("sets_marks", F.lit(False)))
    if known.where(open_).isEmpty():
        return known.withColumn("early", early).drop("sets_marks")
    rare = word_ends(replies).where(f"(ended + 0.05) / (seen + 10.0) < {RARE_END}").select(F.col("word").alias("_word"), F.lit(True).alias("rare"))
    met = known.withColumn("_open", F.when(open_, F.col("last_word"))).join(rare, F.col("_open") == F.col("_word"), "left")
    return met.withColumn("early", early | F.when(asked, F.coalesce("rare", F.lit(False)))).drop("sets_marks", "_open", "_word", "rare")


def _end_mark(content: str) -> bool:
    """Whether a text ends in an end mark that is no ellipsis."""
    shown = content.rstrip()
    return shown.rstrip("\"'”»)*_`")[-1:] in (".", "!", "?", "…") and not shown.endswith("...")


def _gives_back(words: list[str], request: Request) -> bool:
    """Whether a reply of the request's words is more than one candidate, or its instruction."""
    length = sum(map(len, request.candidates)) / len(request.candidates)
    asked = " ".join(plain(request.instruction))
    return len(words) >= LIST_RATIO * length + 1 or (len(words) > 3 and explained(asked, " ".join(words)) >= INSTRUCTION_SHARE)


def _stops_early(content: str, words: list[str], request: Request, own: float, at_limit: bool) -> bool | None:
    """Does the text go on where the reply ends, by the request it answers? None: the request does not say."""
    if _end_mark(content):
        return False
    end = content.rstrip().rstrip("\"'”»)*_`")[-1:]
    if request.candidates and own >= OWN_WORDS and _gives_back(words, request):
        if any(words[-3:] == c[-3:] for c in request.candidates):
            return False
        asked, listed = plain(request.instruction), [w for c in request.candidates for w in c]
        _, left, cut = min((left_over(words, t) for t in (asked, listed, asked + listed, listed + asked)), key=lambda f: (f[0], f[1]))
        return cut or left > 3
    if request.candidates and own >= OWN_WORDS:
        if words in request.candidates:
            return False
        fits = [left_over(words, c) for c in request.candidates if c]
        least = min(f[0] for f in fits)
        # the candidates that the reply follows best; a complete one of them settles it
        near = [f for f in fits if f[0] <= least + 1]
        if any(cut for _, _, cut in near) and not any(words[-1] in c for c in request.candidates):
            return True  # the first letters of the word that follows, and no word of the list
        return not any(left == 0 and not cut for _, left, cut in near)
    if request.candidates:
        return at_limit or end in (",", ";", ":", "-")
    if len(words) < 3:
        return False
    # answers and summaries are sentences; one without its end goes on, unless its words end a sentence of the passage
    tail = words[-3:]
    if any(s[-3:] == tail for s in request.sentences):
        return False
    # the first letters of the word with which the passage goes on
    around = " " + " ".join(plain(request.passage)) + " "
    at = around.find(" " + " ".join(tail))
    if at >= 0 and around[at + len(" ".join(tail)) + 1] != " " and f" {' '.join(tail)} " not in around:
        return True
    return True if at_limit else None


#: The verdict on a reply of which only the terminal-context model can tell whether it is cut.
OPEN_END = "open"


def defect(messages: list[dict] | None, reply: str | None, output_tokens: int | None = None, most_tokens: int | None = None) -> str | None:
    """The defect of one exchange's reply, or None, or OPEN_END. Where several apply, the first of: empty,
    copied, refusal, wrong_language, truncated."""
    if reply is None:
        return "empty"
    content, closed = unwrap(reply)
    words = plain(content)
    if not words or content.lower().strip() in NO_CONTENT or _lone_label.match(content) or reply.strip().lower() in NO_CONTENT:
        return "empty"
    request = Request(messages)
    if _choice.match(content):
        return None if closed else "truncated"
    said = " ".join(words)
    instruction, passage = " ".join(plain(request.instruction)), " ".join(plain(request.passage))
    # a whole sentence of the passage answers a question, however much of the question it repeats
    if len(words) >= 4 and len(instruction.split()) >= 4 and words not in request.sentences and explained(instruction, said) >= INSTRUCTION_SHARE:
        return "copied"
    own = own_share(words, request)
    if request.candidates:
        length = sum(map(len, request.candidates)) / len(request.candidates)
        lines = [x for x in content.split("\n") if _candidate.match(x)]
        if len(request.candidates) > 1 and ((own >= OWN_WORDS and len(words) >= LIST_RATIO * length + 1 and len(words) > 4) or len(lines) > 1):
            return "copied"
    elif passage:
        share = explained(passage, said)
        if share >= (QUOTED_PASSAGE_SHARE if request.question else PASSAGE_SHARE) and _sentences_held(request, said) > 1:
            return "copied"
    if own < OWN_WORDS:
        if declines(content):
            return "refusal"
        if _other_language(content, words, request, own):
            return "wrong_language"
    if not closed:
        return "truncated"
    at_limit = bool(output_tokens and most_tokens and output_tokens >= most_tokens)
    early = _stops_early(content, words, request, own, at_limit)
    return OPEN_END if early is None else "truncated" if early else None


#: A reply of so many words with a smaller share of the asked language's function words is in none that it knows.
LEAST_WORDS, LEAST_FUNCTION_WORDS = 4, 0.12


def _other_language(content: str, words: list[str], request: Request, own: float) -> bool:
    """Is a reply that is not made of the request's words written in another script or language?"""
    letters = sum(map(str.isalpha, content))
    foreign = len(_foreign_script.findall(content))
    if not _foreign_script.search(request.text):
        if letters and foreign > 0.5 * letters:
            return True
    elif letters and not foreign and len(_foreign_script.findall(request.text)) > 0.5 * sum(map(str.isalpha, request.text)):
        return True
    asked = language_scores(request.text)
    spoken = language_scores(content)
    first, second = sorted(asked.values(), reverse=True)[:2]
    if first <= second:
        return False
    name = max(asked, key=asked.get)
    # a correction or an answer takes its words from the request; few words of another language tell enough
    bound = bool(request.candidates or request.question) and own < UNKNOWN_WORDS
    if max(spoken.values()) - spoken[name] >= (1 if bound or len(words) < 6 else 1.5):
        return True
    known = sum(name in _languages.get(w, ()) for w in words)
    return own < UNKNOWN_WORDS and len(words) >= LEAST_WORDS and known < LEAST_FUNCTION_WORDS * len(words)


def own_share(words: list[str], request: Request) -> float:
    """How much of a reply is the request's own words."""
    share = explained(" ".join(words), " ".join(plain(request.everything)))
    if len(words) <= SHORT_REPLY:
        known = set(plain(request.text))
        share = max(share, sum(w in known and not w.isdigit() for w in words) / len(words))
    return share


def _sentences_held(request: Request, said: str) -> int:
    """How many of the passage's sentences the reply holds, wholly or for the most part."""
    held, around = 0, f" {said} "
    for s in request.sentences:
        grams = [" ".join(s[i : i + 4]) for i in range(max(1, len(s) - 3))]
        held += sum(f" {g} " in around for g in grams) >= 0.6 * len(grams)
    return held


def _most_tokens(parameters: str | None) -> int | None:
    try:
        value = json.loads(parameters).get("max_tokens") if parameters else None
        return int(value) if value is not None else None
    except (ValueError, TypeError, AttributeError):
        return None


def judge(exchanges: DataFrame) -> DataFrame:
    """(exchange_id, model_id, defect) of every exchange; defect is null where the reply is sound.

    A null reply is empty. Null messages leave a reply without a request: it can then only be
    empty, a refusal or cut in its wrapping. Repeated exchanges count under each exchange_id.
    Neither parser_status nor parsed_output is believed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                replies = part.column(3).to_pylist()
                verdicts = [defect(m, r, n, _most_tokens(p)) for m, r, n, p in zip(part.column(2).to_pylist(), replies, *(c.to_pylist() for c in part.columns[4:]))]
                ends = [reply_end(r, v == OPEN_END) for r, v in zip(replies, verdicts)]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array([None if v == OPEN_END else v for v in verdicts], pa.string()), *(pa.array(c, t) for c, t in zip(zip(*ends), (pa.bool_(), pa.bool_(), pa.string())))],
                    names=["exchange_id", "source", "verdict", "has_words", "marked", "last_word"])

    light = exchanges.select(
        "exchange_id", "model_id",
        F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"),
        "raw_response", "output_tokens", "generation_parameters",
    )
    judged = materialize(light.mapInArrow(run, "exchange_id long, source string, verdict string, has_words boolean, marked boolean, last_word string"), "p2-judged")
    rows = settled(judged, exchanges.select(F.col("raw_response").alias("text")))
    return rows.select("exchange_id", F.col("source").alias("model_id"), F.when(F.col("early"), "truncated").otherwise(F.col("verdict")).alias("defect"))


def reply_end(reply: str | None, asked: bool) -> tuple[bool, bool, str | None]:
    """Whether a reply has words and a marked end, and its last word where it is asked for."""
    content, closed = unwrap(reply or "")
    words = plain(content)
    return bool(words), bool(words and closed and _end_mark(content)), words[-1] if asked else None


def found(exchanges: DataFrame) -> DataFrame:
    """p2_found: (exchange_id, defect) of every defective exchange."""
    return judge(exchanges).where("defect is not null").select("exchange_id", "defect")
