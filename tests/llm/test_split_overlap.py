import random

from hypomill.llm import split_overlap as S

SCHEMA = "row_id bigint, utt_id string, split string, reference_normalized string, dataset string, words string, train boolean"


def manifest(spark, rows):
    return spark.createDataFrame([(k, u, s, t, "d", "clash", None) for k, (u, s, t) in enumerate(rows)], SCHEMA)


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
        last = row
    return last[-1]


def brute(rows):
    import re

    ws = [re.findall(r"[^\W_]+", (t or "").lower()) for _, _, t in rows]
    train = [(s or "").strip().lower().startswith("train") for _, s, _ in rows]
    out = set()
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if train[i] == train[j]:
                continue
            a, b = ws[i], ws[j]
            near = min(len(a), len(b)) >= 8 and 100 * distance(a, b) <= 15 * max(len(a), len(b))
            if near or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                out.add((i, j))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))]
        rows.append((rng.choice([f"u{k}", f"u{k % 20}", None]), rng.choice(["train-clean", "TRAIN_x", "dev", None]), " ".join(base)))
        for _ in range(2):
            other = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 7))):
                p = rng.randrange(len(other))
                other[p : p + 1] = rng.choice([[], [rng.choice(vocabulary)], [other[p], rng.choice(vocabulary)]])
            rows.append((None, rng.choice(["train", "test-clean", "dev"]), "  ".join(other).upper() + "."))
    rows += [("u0", "train", None), ("u0", "dev", ""), (None, None, "thank you")]
    want = brute(rows)
    got = {(r.row_a, r.row_b) for r in S.overlaps(manifest(spark, rows)).collect()}
    assert got <= want
    assert len(got) >= 0.99 * len(want) and len(want) > 100
    # counts from classes are those of the expanded pairs
    split = {k: None if s is None else s.lower().replace("_", "-") for k, (_, s, _) in enumerate(rows)}
    side = {k: (s or "").startswith("train") for k, s in split.items()}
    pairs, having = {}, {}
    for pair in got:
        e = next(k for k in pair if not side[k])
        pairs[split[e]] = pairs.get(split[e], 0) + 1
        having.setdefault(split[e], set()).add(e)
    counts = {r.split: (r.pairs, r.rows) for r in S.overlap_counts(manifest(spark, rows)).collect()}
    assert counts == {k: (n, len(having[k])) for k, n in pairs.items()}
    by_text = {(a, b) for a, b in got if rows[a][2] and rows[b][2] and distance(rows[a][2].lower().strip(".").split(), rows[b][2].lower().strip(".").split()) * 100 <= 15 * max(len(rows[a][2].split()), len(rows[b][2].split())) and min(len(rows[a][2].split()), len(rows[b][2].split())) >= 8}
    links = {r.row_id: r.links for r in S.row_links(manifest(spark, rows)).collect()}
    assert {k: n for k, n in links.items() if n} == {k: sum(k in p for p in by_text) for k in {x for p in by_text for x in p}}


def test_copies_and_popular_texts(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, "train", text)] * 30 + [(None, "dev", text.upper() + "!")] * 20 + [(None, "dev", "short phrase")] * 5 + [(None, "train", "short phrase")] * 5
    df = S.overlaps(manifest(spark, rows))
    assert df.columns == ["row_a", "row_b"] and df.count() == 600
    report = S.overlap_counts(manifest(spark, rows)).first()
    assert (report.dataset, report.split, report.pairs, report.rows) == ("d", "dev", 600, 20)
    assert {(r.class_id, r.links) for r in S.row_links(manifest(spark, rows)).collect()} == {(0, 20), (0, 30)}


def test_empty_and_long(spark):
    none = manifest(spark, [("u", "train", "x")]).where("false")
    assert S.overlaps(none).count() == S.overlap_counts(none).count() == S.row_links(none).count() == 0
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(None, "train", long), (None, "dev", long.replace("w7 ", "x ")), (None, "dev", long[:9000])]
    assert [(r.row_a, r.row_b) for r in S.overlaps(manifest(spark, rows)).collect()] == [(0, 1)]


def test_row_form_of_the_band_equals_cells():
    rng = random.Random(9)
    small = S._CELLS
    try:
        for _ in range(500):
            a = [rng.choice("abc") for _ in range(rng.randint(1, 15))]
            b = [rng.choice("abc") for _ in range(rng.randint(1, 15))]
            k = rng.randint(0, 6)
            S._CELLS = 0
            rows = S.within_edits(a, b, k)
            S._CELLS = small
            assert rows == S.within_edits(a, b, k) == (distance(a, b) <= k)
    finally:
        S._CELLS = small


def test_repeated_words(spark):
    rows = []
    for k in range(40):
        text = [f"no{k}"] * 20
        rows.append((None, "train", " ".join(text)))
        text[4], text[9], text[14] = f"a{k}", f"b{k}", f"c{k}"
        rows.append((None, "dev", " ".join(text)))
    got = {(r.row_a, r.row_b) for r in S.overlaps(manifest(spark, rows)).collect()}
    assert got <= {(2 * k, 2 * k + 1) for k in range(40)} and len(got) >= 38


def test_no_table_goes_through_the_driver_by_its_guessed_size(spark, tmp_path, monkeypatch):
    # buckets are 32 rows a text, but are taken for smaller than the texts' compressed files
    rng = random.Random(10)
    rows = []
    for k in range(60):
        text = [rng.choice("abcdefghijkl") * 3 + str(k) for _ in range(12)]
        rows += [(f"u{k}", "train", " ".join(text)), (f"u{k % 7}", "dev", " ".join(text[:-1] + ["other"]))]
    manifest(spark, rows).write.parquet(str(tmp_path / "manifest"))
    given = spark.read.parquet(str(tmp_path / "manifest"))
    near, plans = S.near_classes, []

    def seen(classes):
        plans.append(near(classes))
        return plans[0]

    monkeypatch.setattr(S, "near_classes", seen)
    monkeypatch.setattr(S, "SMALL_ROWS", 10)
    found = S.overlaps(given)
    pairs = {(r.row_a, r.row_b) for r in found.collect()}
    assert pairs <= brute(rows) and len(pairs) >= 0.99 * len(brute(rows))
    for df in (plans[0], found):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
