import random

from hypomill.llm import leakage as L

RNG = random.Random(11)
WORDS = [f"w{k}x" for k in range(300)]


def text(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def best_run(item, doc):
    """Whether any run of item words that begins and ends with an agreeing word has 12 words and at most one edit in six (brute force)."""
    for a in range(len(item)):
        for b in range(a + 12, len(item) + 1):
            run = item[a:b]
            last = [0] * (len(doc) + 1)
            for i, w in enumerate(run, 1):
                row = [i]
                for j, v in enumerate(doc, 1):
                    row.append(min(last[j - 1] + (w != v), last[j] + 1, row[j - 1] + 1))
                last = row
            if min(last) * 6 <= len(run):
                return True
    return False


def noisy(words, edits):
    words = words[:]
    for _ in range(edits):
        p = RNG.randrange(1, len(words) - 1)
        words[p : p + 1] = RNG.choice([[], [RNG.choice(WORDS)], [words[p], RNG.choice(WORDS)]])
    return words


def test_equals_brute_force():
    items = [(k, text(RNG.randint(12, 30))) for k in range(12)]
    automaton = L.SuffixAutomaton(items)
    agree = hits = 0
    for _ in range(150):
        k = RNG.randrange(len(items))
        own = items[k][1]
        a = RNG.randrange(0, len(own) - 11)
        n = RNG.randint(6, len(own) - a)
        part = own[a : a + n]
        doc = text(RNG.randint(0, 15)) + (noisy(part, RNG.randint(0, 3)) if n > 3 else part) + text(RNG.randint(0, 15))
        got = k in automaton.matches(doc)
        want = best_run(own, doc)
        hits += want
        agree += got == want
    # brute force also admits edits at a run's ends, which are no part of a passage here
    assert agree >= 135 and hits > 40


def test_exact_lengths():
    item = text(40)
    automaton = L.SuffixAutomaton([(5, item)])
    assert automaton.matches(text(10) + item[3:15] + text(10)) == {0: (10, 21)}
    assert automaton.matches(text(10) + item[3:14] + text(10)) == {}
    assert automaton.matches([]) == {}


def test_automaton_holds_every_stretch_of_every_item():
    items = [(k, [RNG.choice("abc") for _ in range(30)]) for k in range(5)]
    automaton = L.SuffixAutomaton(items)
    for n in (4, 6):
        for k, (_, ws) in enumerate(items):
            for a in range(len(ws) - n + 1):
                state = 0
                for w in ws[a : a + n]:
                    state = automaton.step[state][automaton.vocabulary[w]]
                want = {(i, p + n - 1) for i, (_, vs) in enumerate(items) for p in range(len(vs) - n + 1) if vs[p : p + n] == ws[a : a + n]}
                assert set(automaton.occurrences(state)) == want


PASSAGE = "The miller counted forty sacks of flour near the old bridge before the lantern went out"


def test_layout_is_ignored():
    automaton = L.SuffixAutomaton([(1, L.words_of(PASSAGE))])
    for doc in (PASSAGE.upper(), PASSAGE.replace(" ", "\n- "), "x " + PASSAGE.replace(" of", " of\n[0012]").replace(" old", "\nSpeaker 2: old"), PASSAGE.replace("forty", "40")):
        assert automaton.matches(L.words_of(doc))


def test_tables(spark):
    docs = spark.createDataFrame([(1, "So " + PASSAGE, 0), (1, "So " + PASSAGE, 0), (2, None, 0), (3, "", 0), (4, "word " * 50000 + PASSAGE, 0), (5, "The miller counted forty sacks", 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, PASSAGE, "d"), (8, PASSAGE + " again", "d"), (9, None, "d"), (10, "too short to count", "d")], "item_id bigint, text string, doc_id string")
    want = sorted((d, i) for d in (1, 1, 4) for i in (7, 8))
    assert sorted((r.doc_id, r.item_id) for r in L.found(docs, items).collect()) == want
    old, L.BLOCK_WORDS = L.BLOCK_WORDS, 5
    try:
        assert sorted((r.doc_id, r.item_id) for r in L.found(docs, items).collect()) == want
    finally:
        L.BLOCK_WORDS = old
    assert L.found(docs, items.where("false")).count() == 0
    assert L.found(docs.where("false"), items).count() == 0


def test_cleaning_takes_out_every_passage_and_nothing_else(spark):
    other = "Seven boats drifted past the silent harbour while nobody watched the tide come in. " * 3
    text = f"{other}{PASSAGE}. {other}{PASSAGE.upper()}! İstanbul stays. {other}"
    docs = spark.createDataFrame([(1, text), (2, PASSAGE), (3, None), (4, ""), (5, other)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, PASSAGE)], "item_id bigint, text string")
    got = {r.doc_id: r for r in L.cleaned(docs, items).collect()}
    assert got[1].text == f"{other}. {other}! İstanbul stays. {other}" and got[1].leaked_words == 32
    assert got[2].text is None and got[2].leaked_words == got[2].words == 16
    assert (got[3].text, got[4].text, got[5].text) == (None, "", other)
    left = spark.createDataFrame([(r.doc_id, r.text) for r in got.values()], "doc_id bigint, text string")
    assert L.found(left, items).count() == 0
    assert {r.doc_id: r.text for r in L.cleaned(docs, items.where("false")).collect()} == {1: text, 2: PASSAGE, 3: None, 4: "", 5: other}


def every_run(item, doc):
    """Document words that lie in any admitted run (brute force over alignments that begin and end with an agreeing word)."""
    covered = set()
    for a in range(len(item)):
        for p in range(len(doc)):
            if item[a] != doc[p]:
                continue
            last = {0: 0}  # row of one item word: edits by document words after p
            for j in range(1, len(doc) - p):
                last[j] = j
            for i in range(1, len(item) - a):
                row = {0: i}
                for j in range(1, len(doc) - p):
                    same = item[a + i] == doc[p + j]
                    row[j] = min(last[j - 1] + (not same), last[j] + 1, row[j - 1] + 1)
                    if same and i + 1 >= 12 and last[j - 1] * 6 <= i + 1:
                        covered.update(range(p, p + j + 1))
                last = row
    return covered


def test_passages_are_whole():
    words = [f"p{k}x" for k in range(36)]
    automaton = L.SuffixAutomaton([(1, words[:24])])
    doc = ["before", *words[:12], "altered", *words[13:24], "after"]
    assert automaton.passages(doc) == {0: [(1, 24)]}
    assert L.without_passages(" ".join(doc), [automaton]) == ("before  after", 26, 24)
    often = [w if k % 7 != 6 else "altered" for k, w in enumerate(words)]  # 5 edits in 36
    automaton = L.SuffixAutomaton([(1, words)])
    assert automaton.passages(["x", *often, "y"]) == {0: [(1, 36)]}
    assert L.without_passages(" ".join(["x", *often, "y"]), [automaton]) == ("x  y", 38, 36)


def test_passages_are_all_words_of_admitted_runs():
    rng = random.Random(12)
    hits = 0
    for _ in range(40):
        item = [f"q{k}x" for k in range(rng.randint(14, 40))]
        part = item[rng.randint(0, 3) :]
        for _ in range(rng.randint(0, len(part) // 5)):
            p = rng.randrange(1, len(part) - 1)
            part[p : p + 1] = rng.choice([[], ["z"], [part[p], "z"]])
        doc = ["b"] * 3 + part + ["e"] * 3
        got = {i for a, b in L.SuffixAutomaton([(0, item)]).passages(doc).get(0, []) for i in range(a, b + 1)}
        hits += bool(got)
        assert got == every_run(item, doc)
    assert hits > 25


def test_every_passage_has_a_row(spark):
    docs = spark.createDataFrame([(1, f"{PASSAGE}. " + "And then nothing at all came of it. " * 2 + PASSAGE)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, PASSAGE)], "item_id bigint, text string")
    assert sorted((r.first_word, r.last_word) for r in L.spans(docs, items).collect()) == [(0, 15), (32, 47)]
    assert L.found(docs, items).count() == 1


def test_a_stem_of_all_items_changes_nothing():
    """Items that share a stem are compared in one array; the result is that of opening each one."""
    stem = text(9)
    items = [(k, [*stem[: RNG.randint(4, 9)], *text(RNG.randint(8, 25))]) for k in range(150)] + [(500 + k, [*text(6), *stem, *text(6)]) for k in range(150)]
    docs = []
    for _ in range(60):
        own = RNG.choice(items)[1]
        a = RNG.randrange(0, 6)
        part = own[a : a + RNG.randint(10, 30)]
        docs.append(text(RNG.randint(0, 8)) + (noisy(part, RNG.randint(0, 3)) if len(part) > 4 else part) + text(RNG.randint(0, 8)) + stem + text(3))
    old = L.HOT
    try:
        L.HOT = 10**9
        want = [L.SuffixAutomaton(items).passages(d, w) for d in docs for w in (True, False)]
        L.HOT = 8
        got = [L.SuffixAutomaton(items).passages(d, w) for d in docs for w in (True, False)]
    finally:
        L.HOT = old
    assert [set(x) for x in got] == [set(x) for x in want] and sum(map(len, want)) > 50
    assert got[::2] == want[::2]


def test_slices_lose_nothing():
    import pyarrow as pa

    old, L.SLICE_BYTES = L.SLICE_BYTES, 10
    try:
        batch = pa.record_batch([pa.array(range(6)), pa.array(["a" * 8, None, "b" * 30, "", "c", "d" * 9])], names=["id", "text"])
        pieces = list(L.slices([batch, batch.slice(0, 0)]))
    finally:
        L.SLICE_BYTES = old
    assert [x for p in pieces for x in p.column(0).to_pylist()] == list(range(6)) and len(pieces) > 2
