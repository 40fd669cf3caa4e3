import json

import pytest

from hypomill.llm import broken_pairs as B

CANDIDATES = "1. the grey harbour polished seven stout anchors before the narrow tavern quietly closed\n2. the grey harbour polished seven stout anchors before a narrow tavern quietly closed\n3. the gray harbour polished seven stoat anchors before the narrow tavern quietly closed"
CORRECT = "Correct the transcript using the candidate hypotheses below. Reply with the corrected sentence only."
PASSAGE = "The pilot carried a lantern across the frozen meadow. Her cousin repaired the engine near the old mill. At noon the miller counted forty sacks of flour. Nobody noticed the small boat beneath the bridge."
QUESTION = "Which sentence mentions the engine?"
SUMMARY = "Write a short summary of this transcript."
GERMAN = "Korrigiere das Transkript anhand der folgenden Hypothesen. Antworte nur mit dem korrigierten Satz.\n\n1. der müller sah das brot neben der mühle\n2. der müller sah das brot neben mühle"


def ask(*parts):
    return [{"role": "system", "content": "Be brief."}, {"role": "user", "content": "\n\n".join(parts)}]


GOOD = "The grey harbour polished seven stout anchors, before the narrow tavern quietly closed."


@pytest.mark.parametrize("reply", [None, "", " \n", "None", "N/A", "{}", "[]", "```\n```", '{"answer": null}', '{"text": ""}', "Corrected transcript:", "...", "-", "<empty>", "​"])
def test_empty(reply):
    assert B.defect(ask(CORRECT, CANDIDATES), reply) == "empty"


@pytest.mark.parametrize("reply", [
    GOOD, GOOD.lower().rstrip("."), "the gray harbour polished seven stoat anchors before the narrow tavern quietly closed", json.dumps({"corrected": GOOD}), f"```\n{GOOD}\n```", f'"{GOOD}"', f"Answer: {GOOD}", "Candidate 2: the grey harbour polished seven stout anchors before a narrow tavern quietly closed", "2.", "rank 3", "1",
])
def test_sound_corrections(reply):
    assert B.defect(ask(CORRECT, CANDIDATES), reply) is None
    assert B.defect(ask(CANDIDATES, CORRECT), reply) is None


def test_sound_answers():
    assert B.defect(ask(QUESTION, PASSAGE), "Her cousin repaired the engine near the old mill.") is None
    assert B.defect(ask("Question: " + QUESTION, PASSAGE), "You asked about the engine. Her cousin repaired the engine near the old mill.") is None
    assert B.defect(ask(SUMMARY, PASSAGE), "Some people worked through a cold day while a craft stayed hidden from view.") is None
    assert B.defect(ask(GERMAN), "Der Müller sah das Brot neben der Mühle.") is None


@pytest.mark.parametrize("reply", [CANDIDATES, CORRECT, "Task: " + CORRECT, CORRECT + "\n" + CANDIDATES])
def test_copied_requests(reply):
    assert B.defect(ask(CORRECT, CANDIDATES), reply) == "copied"


def test_copied_passages():
    assert B.defect(ask(SUMMARY, PASSAGE), PASSAGE) == "copied"
    assert B.defect(ask(QUESTION, PASSAGE), PASSAGE) == "copied"
    assert B.defect(ask(SUMMARY, PASSAGE), SUMMARY + " The pilot carried a lantern across the frozen meadow. Her.") == "copied"


@pytest.mark.parametrize("reply", ["I'm sorry, but I can't help with that.", "Regrettably, the request has been declined.", '{"text": "I must decline to work on this transcript."}', "Es tut mir leid, dabei kann ich nicht helfen.", "As a language model, I am unable to process this recording."])
def test_refusals(reply):
    assert B.defect(ask(CORRECT, CANDIDATES), reply) == "refusal"


def test_refusing_words_of_the_speaker_are_no_refusal():
    said = "i must decline said the pilot before the meadow closed quietly"
    assert B.defect(ask(CORRECT, f"1. {said}\n2. i must decline said pilot before the meadow closed quietly"), said) is None


def test_wrong_language():
    assert B.defect(ask(CORRECT, CANDIDATES), "Der Lehrer trug das stille Haus hinter dem Tor.") == "wrong_language"
    assert B.defect(ask(GERMAN), "Le facteur apporta le petit livre derrière le portail.") == "wrong_language"
    assert B.defect(ask(GERMAN), "The miller saw the bread beside the mill.") == "wrong_language"


@pytest.mark.parametrize("reply", ["The grey harbour polished seven stout anc", '{"corrected": "The grey harbour polished', "the grey harbour polished seven stout anchors before the", "```\nThe grey harbour polished seven"])
def test_truncated(reply):
    assert B.defect(ask(CORRECT, CANDIDATES), reply) == "truncated"


def test_truncated_answers():
    assert B.defect(ask(QUESTION, PASSAGE), "Her cousin repaired the engine ne") == "truncated"
    assert B.defect(ask(SUMMARY, PASSAGE), "Some people worked through a cold day while a cra") == B.OPEN_END


def test_compression_knows_copies():
    assert B.explained("the pilot carried a lantern across the meadow", PASSAGE.lower()) > 0.6
    assert B.explained("forty unrelated words about quite different matters", PASSAGE.lower()) < 0.3


def test_left_over_row_form_equals_cells():
    reply, text = "a b x d e".split() * 40, "a b c d e".split() * 45
    small, B._CELLS = B._CELLS, 0
    try:
        rows = B.left_over(reply, text)
        B._CELLS = 10**9
        assert rows == B.left_over(reply, text)
    finally:
        B._CELLS = small


MESSAGES = "messages array<struct<role:string,content:string,extra:int>>"


def test_table(spark):
    good = [("user", CORRECT + "\n\n" + CANDIDATES, 1)]
    rows = [(1, good, GOOD, 20, "{}", "c"), (2, None, None, None, None, "c"), (3, None, "some words", None, "no json", "c"), (4, [], "I'm sorry, I can't help with that.", 1, None, "c"), (5, [None, ("user", None, 1)], "fine words here.", 1, '{"max_tokens": "x"}', "c"), (6, good, GOOD * 3000, None, None, "c"), (7, good, None, 1, None, "c"), (7, good, None, 1, None, "c")]
    df = spark.createDataFrame([(*r, None if r[0] % 2 else "m") for r in rows], f"exchange_id bigint, {MESSAGES}, raw_response string, output_tokens bigint, generation_parameters string, defect string, model_id string")
    got = B.found(df)
    assert got.columns == ["exchange_id", "defect"]
    assert sorted((r.exchange_id, r.defect) for r in got.collect()) == [(2, "empty"), (4, "refusal"), (6, "copied"), (7, "empty"), (7, "empty")]
    assert B.found(df.where("false")).count() == 0


def test_sources_without_end_marks(spark):
    """A missing mark tells nothing of a source that never sets one; a word that never ends a text does."""
    said = "people walked along the river while boats passed below the bridge".split()
    texts = [("bare", " ".join(said[: 5 + k % 6])) for k in range(300)] + [("neat", " ".join(said[: 5 + k % 6]).capitalize() + ".") for k in range(300)]
    texts = [(s, t) for s, t in texts if not t.rstrip(".").endswith("the")]
    asked = [("bare", "people walked along the river while boats"), ("bare", "people walked along the"), ("neat", "People walked along the river while boats"), (None, "people walked along the")]
    rows = [(k, ask(SUMMARY, PASSAGE), t, None, None, s) for k, (s, t) in enumerate(asked + texts)]
    df = spark.createDataFrame([(k, [(x["role"], x["content"], 1) for x in m], t, n, g, s) for k, m, t, n, g, s in rows], f"exchange_id bigint, {MESSAGES}, raw_response string, output_tokens bigint, generation_parameters string, model_id string")
    got = {r.exchange_id: r.defect for r in B.judge(df).where("exchange_id < 4").collect()}
    assert got == {0: None, 1: "truncated", 2: "truncated", 3: "truncated"}
    counts = {r.word: (r.seen, r.ended) for r in B.word_ends(df.selectExpr("raw_response as text")).collect()}
    assert counts["the"][1] == 0 and counts["below"][1] > 0
    assert counts["people"][0] == len(rows)


def test_a_candidate_in_another_case_is_whole():
    candidates = "1. the cat sat on the mat\n2. the cat sat on the hat"
    for reply in ("The cat sat on the mat", "the cat sat on the mat", "THE CAT SAT ON THE HAT"):
        assert B.defect(ask(CORRECT, candidates), reply) is None


def test_all_texts_of_a_wrapped_reply_count():
    assert B.unwrap('{"lines": ["one", {"x": "two"}], "n": 3}')[0] == "one\ntwo"
    deep = "word"
    for _ in range(12):
        deep = json.dumps({"text": deep})
    assert B.unwrap(deep) == ("word", True)
    assert B.defect(ask(SUMMARY, PASSAGE), json.dumps({"a": PASSAGE[:60], "b": PASSAGE[60:]})) == "copied"


# phrases and languages that no list of the module was made from
HELD_OUT_REFUSALS = [
    "I'd prefer not to do this one.", "This violates our usage policy.", "That is outside my remit.", "Our guidelines prohibit me from responding here.", "I am not in a position to help with that.",
    "Sorry, this one I have to turn down.", "It wouldn't be right for me to handle that recording.", "My instructions do not allow a reply to this.", "I refuse.", "Answering this is not permitted under the terms I operate with.",
    "I will not be doing that.", "Nope, I won't touch this request.", "Dabei kann ich dir leider nicht weiterhelfen.", "Das verstößt gegen meine Richtlinien.", "Ich möchte diese Aufgabe lieber nicht übernehmen.",
    "Je préfère ne pas répondre à cette demande.", "Cette requête n'est pas autorisée par mes règles.", "No me está permitido hacer eso.", "Prefiero no contestar a esta petición.", "Daar kan ik helaas niet mee helpen.",
    "Mi dispiace, non posso aiutarti con questo.", "Infelizmente não posso ajudar com isso.",
]
HELD_OUT_LANGUAGES = [
    "De slotenmaker rustte bij de fontein terwijl de kinderen zongen op het plein.", "Il fabbro riposava vicino alla fontana mentre i bambini cantavano nella piazza.", "O serralheiro descansava perto da fonte enquanto as crianças cantavam na praça.",
    "Låssmeden vilade nära fontänen medan barnen sjöng på torget i regnet.", "Ślusarz odpoczywał przy fontannie, a dzieci śpiewały na placu.", "鍵屋は噴水の近くで休み、子供たちは雨の中で歌った。", "Слесарь отдыхал у фонтана, пока дети пели на площади.",
    "Çilingir çeşmenin yanında dinlenirken çocuklar meydanda şarkı söylüyordu.", "Lukkoseppä lepäsi suihkulähteen luona lasten laulaessa torilla.", "锁匠在喷泉旁休息,孩子们在雨中唱歌。",
]
TASKS = [(SUMMARY, PASSAGE), (QUESTION, PASSAGE), (CORRECT, CANDIDATES)]


def recall(replies, want):
    return sum(B.defect(ask(*t), r) == want for t in TASKS for r in replies) / (len(TASKS) * len(replies))


def test_held_out_refusals_and_languages():
    assert recall(HELD_OUT_REFUSALS, "refusal") >= 0.9
    assert recall(HELD_OUT_LANGUAGES, "wrong_language") >= 0.9


def test_sound_replies_of_all_tasks():
    for reply in ("The pilot crossed a meadow, and a miller counted sacks.", "Her cousin repaired the engine near the old mill.", "Nobody noticed the small boat beneath the bridge."):
        assert B.defect(ask(SUMMARY, PASSAGE), reply) is None
