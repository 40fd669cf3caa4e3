import hashlib
import json
import math

import pytest

from hypomill import cli, schemas, tracking
from hypomill.errors import ConfigError, HypomillError, ManifestError, StoreError
from hypomill.functions.jsoncanon import canonical_json, canonical_json_text, config_sha256, run_id
from hypomill.sources import jsonl, transcripts


def corpus(root, split="test-clean", lines=("1-2-0000 HELLO, WORLD!", "1-2-0001 I'VE GOT 2 APPLES"), audio=None):
    folder = root / split / "1" / "2"
    folder.mkdir(parents=True)
    (folder / "1-2.trans.txt").write_text("\n".join(lines) + "\n")
    for k in range(len(lines)):
        (folder / f"1-2-000{k}.flac").write_bytes((audio or {}).get(k, b"fLaC" + str(k).encode()))
    return root


def test_transcripts(spark, tmp_path):
    corpus(tmp_path)
    rows = transcripts.manifest(spark, str(tmp_path), "test-clean").orderBy("utt_id").collect()
    assert [(r.utt_id, r.reference_normalized) for r in rows] == [("1-2-0000", "hello world"), ("1-2-0001", "i've got 2 apples")]
    assert rows[0].audio_path == "test-clean/1/2/1-2-0000.flac"
    assert rows[0].audio_sha256 == hashlib.sha256(b"fLaC0").hexdigest()


@pytest.mark.parametrize("change,message", [
    ({"audio": {0: b"invalid"}}, "broken audio"), ({"audio": {1: b"f"}}, "broken audio"), ({"lines": ("1-2-0000 HI", "lonely")}, "broken transcript line 2 in"), ({"lines": ("1-2-0000 HI", "")}, "broken transcript line 2 in"), ({"lines": ("1-2-0000 ...",)}, "empty reference"),
])
def test_broken_corpora(spark, tmp_path, change, message):
    corpus(tmp_path, **change)
    with pytest.raises(Exception, match=message):
        transcripts.manifest(spark, str(tmp_path), "test-clean").collect()


def test_missing_audio(spark, tmp_path):
    corpus(tmp_path)
    (tmp_path / "test-clean/1/2/1-2-0001.flac").unlink()
    with pytest.raises(Exception, match="missing audio"):
        transcripts.manifest(spark, str(tmp_path), "test-clean").collect()


def test_manifest_is_written_once(spark, tmp_path):
    corpus(tmp_path / "in")
    m = transcripts.manifest(spark, str(tmp_path / "in"), "test-clean")
    one, two = tracking.write_manifest_once(m, tmp_path / "out"), tracking.write_manifest_once(m, tmp_path / "out")
    assert one == two and one.count == 2 and one.path.parent.name == one.sha256
    lines = one.path.read_text().splitlines()
    assert lines == sorted(lines) and lines[0] == canonical_json(json.loads(lines[0]))
    assert tracking.file_sha256(one.path) == one.sha256
    assert jsonl.manifest(spark, str(one.path)).count() == 2
    one.path.write_text("changed")
    with pytest.raises(StoreError):
        tracking.write_manifest_once(m, tmp_path / "out")
    with pytest.raises(ManifestError):
        tracking.write_manifest_once(m.unionByName(m), tmp_path / "out")
    with pytest.raises(ManifestError):
        tracking.write_manifest_once(m.where("false"), tmp_path / "out")


def test_canonical_json(spark):
    assert canonical_json({"b": 1.0, "a": "é"}) == '{"a":"\\u00e9","b":1.0}'
    assert config_sha256({"x": 1, "y": 2}) == config_sha256({"y": 2, "x": 1}) != config_sha256({"x": 1, "y": 3})
    for bad in ({"x": math.nan}, {1: 2}, {"x": b""}, {"x": object()}):
        with pytest.raises(ConfigError):
            canonical_json(bad)
    assert run_id("ab-1", {}).startswith("ab-1-") and len(run_id("a", {}, 64)) == 66
    for prefix, n in (("A", 12), ("", 12), ("a", 7), ("a", 65)):
        with pytest.raises(ConfigError):
            run_id(prefix, {}, n)
    df = spark.createDataFrame([('{"b": 1, "a": [1.0, null]}',), ("x",), (None,), ('{"a": NaN}',)], "t string")
    assert [r[0] for r in df.select(canonical_json_text("t")).collect()] == ['{"a":[1.0,null],"b":1}', None, None, None]


def test_store(tmp_path):
    store = tracking.ContentStore(tmp_path)
    a, b = store.put(b"abc", ".txt"), store.put(b"abc", ".txt")
    assert a == b and a.path.parent.name == a.sha256[:2]
    a.path.write_bytes(b"abd")
    with pytest.raises(StoreError):
        store.put(b"abc", ".txt")
    for payload, suffix in (("text", ""), (b"x", "txt"), (b"x", ".A")):
        with pytest.raises(StoreError):
            store.put(payload, suffix)


def test_runs(tmp_path):
    one, m = tracking.start_run(tmp_path, "job", {"n": 5}, ("c",))
    two, _ = tracking.start_run(tmp_path, "job", {"n": 5}, ("c",))
    assert two.name == one.name + "-attempt-01"
    tracking.finish_run(one, m, {"out": "hash"})
    assert json.loads((one / "run_manifest.json").read_text())["output_artifact_hashes"] == {"out": "hash"}
    with pytest.raises(StoreError):
        tracking.start_run(tmp_path, "job", {"n": 5}, ("c",), retry=False)
    with pytest.raises(ConfigError):
        tracking.start_run(tmp_path, "job", {}, ())


def test_assumptions(tmp_path):
    a = tracking.Assumptions()
    a.add("x", "choice", "reason", "PAPER")
    for args in (("x", "c", "r", "PAPER"), (" ", "c", "r", "PAPER"), ("y", "c", "r", "GUESS")):
        with pytest.raises(ConfigError):
            a.add(*args)
    a.write_once(tmp_path / "a.json")
    with pytest.raises(StoreError):
        a.write_once(tmp_path / "a.json")


def test_lenient_and_strict_scan(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"utt_id": "u", "rank": 1, "unknown": 2}\n\n{"rank": "x"}\n')
    assert jsonl.scan(spark, str(path), schemas.NBEST_LINE, strict=False).where("_broken is not null").count() == 1
    with pytest.raises(Exception, match="broken line"):
        jsonl.scan(spark, str(path), schemas.NBEST_LINE).collect()
    for bad in (0, True, "x"):
        with pytest.raises(ManifestError):
            jsonl.scan(spark, str(path), schemas.NBEST_LINE, first=bad)


def test_first_records_in_file_order(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("".join(json.dumps({"utt_id": u}) + "\n\n" for u in "zyxab"))
    assert [r.utt_id for r in jsonl.manifest(spark, str(path), 3).collect()] == ["z", "y", "x"]


def test_outputs_exchanges_and_pairs_round_trip(spark, tmp_path):
    out = spark.createDataFrame([("u1", "sys", "closest", "A b", "a b", 1, 0.5, -1.0, -2.0, -1.5, "parsed", 3.0, False, '{"k":1}')], schemas.EC_OUTPUT)
    made = tracking.write_outputs_once(out, tmp_path, "sys")
    assert jsonl.outputs(spark, str(made.path)).collect() == out.collect()
    with pytest.raises(ManifestError):
        tracking.write_outputs_once(out, tmp_path, "other")
    exchange = spark.createDataFrame(
        [("ab" * 32, "p", "m", [("user", "say")], "{}", "t1", "t2", "said", ("said", "said"), None, "parsed", 5, 2, 1.0, 0, [])], schemas.LLM_EXCHANGE)
    back = jsonl.exchanges(spark, str(tracking.write_exchanges_once(exchange, tmp_path, "m").path)).first()
    assert (back.messages[0].content, back.parsed_output.raw, back.requested_utc, back.errors) == ("say", "said", None, [])
    pair = spark.createDataFrame([("u1", "a [SEP] b", "A", "a", 2, "literal-sep@v1", "0" * 64)], schemas.EC_PAIR)
    assert jsonl.training_pairs(spark, str(tracking.write_pairs_once(pair, tmp_path, "pairs").path)).collect() == pair.collect()


def write(path, value):
    path.write_text(json.dumps(value))
    return path


def test_command_line(spark, tmp_path, capsys):
    corpus(tmp_path / "in")
    config = {"dataset": "librispeech", "source_root": str(tmp_path / "in"), "output_root": str(tmp_path / "out"), "runs_root": str(tmp_path / "runs"), "normalizer": "conservative-english@v1", "splits": ["test-clean"], "expected_counts": {"test-clean": 2}}
    path = write(tmp_path / "data.json", config)
    assert cli.main(["prepare-data", "--config", str(path), "--dry-run"], spark) == 0
    assert json.loads(capsys.readouterr().out)["artifacts"] == [{"split": "test-clean", "record_count": 2}]
    assert not (tmp_path / "out").exists() and not (tmp_path / "runs").exists()
    assert cli.main(["prepare-data", "--config", str(path)], spark) == 0
    manifest = json.loads(capsys.readouterr().out)["artifacts"][0]["path"]

    beams = tmp_path / "beams.jsonl"
    beams.write_text("".join(json.dumps({"utt_id": u, "original_index": k, "token_ids": [1, 2], "sum_logprob": s, "text": t}) + "\n"
                             for u, texts in (("1-2-0000", ["Hello, word!", "Hello, world!"]), ("1-2-0001", ["I've got 2 apples.", "I've got two apples"])) for k, (t, s) in enumerate(zip(texts, (-2.0, -1.0)))))
    config = cli.DECODER_SETTINGS | {"nbest": 2, "beam_size": 2, "manifest_path": manifest, "beams_path": str(beams), "output_root": str(tmp_path / "nbest"), "runs_root": str(tmp_path / "runs")}
    path = write(tmp_path / "asr.json", config)
    assert cli.main(["generate-nbest", "--config", str(path), "--dry-run"], spark) == 0
    assert json.loads(capsys.readouterr().out)["requested_records"] == 2
    hashes = []
    for _ in range(2):
        assert cli.main(["generate-nbest", "--config", str(path)], spark) == 0
        made = json.loads(capsys.readouterr().out)["artifact"]
        hashes.append(made["sha256"])
    assert hashes[0] == hashes[1]
    first = json.loads((tmp_path / "nbest" / "small.en" / made["sha256"] / "records.jsonl").read_text().splitlines()[0])["asr"]["hypotheses"][0]
    assert (first["rank"], first["source_original_rank"], first["text_normalized"]) == (1, 2, "hello world")

    assert cli.main(["evaluate-nbest", "--artifact", made["path"], "--runs-root", str(tmp_path / "runs")], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["requested_n"] == 2 and got["metrics"]["oracle_by_n"]["2"]["error_rate"] == 0.0 and got["metrics"]["baseline"]["counts"]["errors"] > 0
    assert got["metrics"]["diversity"]["requested_n"] == 2 and got["metrics"]["diversity"]["cross_wer"]["utterance_count"] == 2
    assert json.loads((tmp_path / "runs" / got["run_directory"].split("/")[-1] / "metrics.json").read_text()) == got["metrics"]

    assert cli.main(["build-ec-pairs", "--artifact", made["path"], "--nbest", "2", "--output-root", str(tmp_path / "pairs")], spark) == 0
    built = json.loads(capsys.readouterr().out)
    assert (built["pairs"], built["records_without_pair"]) == (2, 0) and jsonl.training_pairs(spark, built["artifact"]["path"]).count() == 2
    scores = tmp_path / "scores.jsonl"
    scores.write_text("".join(json.dumps({"utt_id": u, "rank": k, "ec_score": -float(k)}) + "\n" for u in ("1-2-0000", "1-2-0001") for k in (1, 2)))
    assert cli.main(["tune-lambda", "--artifact", made["path"], "--scores", str(scores)], spark) == 0
    tuned = json.loads(capsys.readouterr().out)
    assert len(tuned["curve"]) == 21 and tuned["error_rate"] == min(c["error_rate"] for c in tuned["curve"].values()) == tuned["curve"][f"{tuned['selected']:.2f}"]["error_rate"]
    scores.write_text(json.dumps({"utt_id": "1-2-0000", "rank": 1, "ec_score": 0.0}) + "\n")
    with pytest.raises(Exception, match="differ"):
        cli.tune_weight(spark, tmp_path / made["path"], scores)

    bad = write(tmp_path / "bad.json", config | {"beam_size": 3})
    with pytest.raises(SystemExit):
        cli.main(["generate-nbest", "--config", str(bad)], spark)
    with pytest.raises(SystemExit):
        cli.main(["evaluate-nbest", "--artifact", str(tmp_path / "none")], spark)


def test_expected_count_and_errors(spark, tmp_path):
    corpus(tmp_path / "in")
    config = {"dataset": "d", "source_root": str(tmp_path / "in"), "output_root": "o", "normalizer": "identity@v1", "splits": ["test-clean"], "expected_counts": {"test-clean": 3}}
    for change in ({}, {"splits": []}, {"splits": ["gone"]}, {"normalizer": "x"}, {"source_root": ""}):
        with pytest.raises(HypomillError):
            cli.prepare_data(spark, write(tmp_path / "c.json", config | change), True)
