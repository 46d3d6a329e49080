"""The jobs, on copies: rules, reruns, growing input, a replayed batch, and the command lines."""

import json
import logging
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from jobs import curate_release, kmer_ingest

ROOT = Path(__file__).parents[1]
RECORD = "doc_id bigint, text string, lang string, source string"
A, B = "MKV LLA " * 10, "GGG " * 12


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def release(spark, tmp_path):
    rows = [
        (1, A, "en", "s1"), (2, "  " + A.replace(" ", "\n"), "en", "s2"), (3, B, None, "s1"), (4, "short", "en", "s1"), (5, "x" * 1176, "de", "s1"),
        (6, None, "de", "s1"), (7, " \t ", "de", "s1"), (8, A, "en", " "), (9, A, "en", None), (None, B, "en", "s1"), (10, "y" * 1175, "de", "s3"), (11, "z" * 30, "de", "s3"), (0, "short", "en", None),
    ]
    spark.createDataFrame(rows, RECORD).selectExpr("*", "1 as digest", "2 as why").repartition(3).write.parquet(f"{tmp_path}/records")
    spark.createDataFrame([(1, 5), (1, 7), (10, 3), (99, 1)], "vec_id bigint, label int").write.parquet(f"{tmp_path}/families")
    return f"{tmp_path}/records", f"{tmp_path}/families", f"{tmp_path}/out"


def test_release_rules_and_reruns(spark, release, caplog):
    with caplog.at_level(logging.INFO):
        first = curate_release.run(spark, *release)
    got = {r["doc_id"]: (r["status"], r["keep_id"], r["family"]) for r in first.collect()}
    assert got == {
        1: ("kept", 1, 7), 2: ("copy", 1, -1), 3: ("kept", 3, -1), 4: ("short", 4, -1), 5: ("long", 5, -1), 6: ("empty", 6, -1), 7: ("empty", 7, -1), 8: ("unannotated", 8, -1),
        9: ("unannotated", 9, -1), None: ("unnamed", None, -1), 10: ("kept", 10, 3), 11: ("kept", 11, -1), 0: ("unannotated", 0, -1),
    }
    assert "read 13 records" in caplog.text and "'kept': 4" in caplog.text
    before, report = _rows(first), _rows(spark.read.json(f"{release[2]}/report"))
    assert _rows(curate_release.run(spark, *release)) == before and _rows(spark.read.json(f"{release[2]}/report")) == report
    de = spark.read.json(f"{release[2]}/report").where("lang = 'de'").first()
    assert (de["original"], de["curated"], de["copies"], de["percent_removed"], de["longest"]) == (5, 2, 0, 60.0, 1175)
    assert {p.name for p in Path(f"{release[2]}/records").glob("status=*")} == {f"status={s}" for s in ("kept", "copy", "short", "long", "empty", "unannotated", "unnamed")}
    fasta = [r["value"] for r in spark.read.option("lineSep", "\n>").text(f"{release[2]}/fasta").collect()]
    assert sorted(x.lstrip(">").split("\n")[0] for x in fasta) == ["1", "10", "11", "3"]
    # bounds are settings, a rerun with others leaves nothing of the old ones
    assert Counter(r["status"] for r in curate_release.run(spark, *release, {"low": 1, "high": 2000}).collect()) == {"kept": 6, "copy": 1, "empty": 2, "unannotated": 3, "unnamed": 1}
    with pytest.raises(ValueError):
        curate_release.run(spark, *release, {"hihg": 3})


def test_release_of_nothing(spark, release, tmp_path):
    spark.read.parquet(release[0]).limit(0).write.parquet(f"{tmp_path}/none")
    assert curate_release.run(spark, f"{tmp_path}/none", release[1], release[2]).count() == 0


def _vector(text, k):
    seq = "".join(c for c in text or "" if c.isascii() and c.isalpha()).upper()
    c = Counter(seq[i : i + k] for i in range(len(seq) - k + 1))
    return len(seq), len(c), sum(c.values()), " ".join(f"{x}:{n}" for x, n in sorted(c.items()))


def test_vectors_of_growing_input(spark, tmp_path, caplog):
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    add = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(source)
    one = [(1, "Abc de, abcde!"), (2, "ab"), (3, None), (None, "abcdefgh"), (4, "aaaa"), (4, "zzzzzz")]
    two = [(5, "éabcABCabc" * 200), (1, "changed later"), (6, "")]
    config = {"ks": [3, 5]}
    add(one)
    first = kmer_ingest.run(spark, source, out, state, config)
    want = {(i, k): _vector(t, k) for i, t in ((1, one[0][1]), (2, "ab"), (3, None), (4, "zzzzzz")) for k in (3, 5)}
    read = lambda df: {(r["doc_id"], r["k"]): (r["length"], r["n_distinct"], r["n_kmers"], r["vector"]) for r in df.collect()}
    assert read(first) == want and first.count() == len(want)
    before = _rows(first)
    assert _rows(kmer_ingest.run(spark, source, out, state, config)) == before
    add(two)
    with caplog.at_level(logging.INFO):
        second = kmer_ingest.run(spark, source, out, state, config)
    assert "batch 1 read 3 rows" in caplog.text and "wrote 2 new records" in caplog.text
    want |= {(i, k): _vector(t, k) for i, t in ((5, two[0][1]), (6, "")) for k in (3, 5)}
    assert read(second) == want and second.count() == len(want)
    assert {r["doc_id"] for r in second.where("batch = 1").collect()} == {5, 6} and _rows(second.where("batch = 0")) == before
    # the same as one run over all files, whose rows of identifier 1 then meet in one batch
    whole = kmer_ingest.run(spark, source, f"{out}-whole", f"{state}-whole", config)
    assert read(whole.where("doc_id <> 1")) == {a: v for a, v in want.items() if a[0] != 1}


def test_a_batch_that_failed_after_its_write_is_replayed(spark, tmp_path):
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    spark.createDataFrame([(i, "abcdef" * i) for i in range(9)], "doc_id bigint, text string").write.parquet(source)
    done = _rows(kmer_ingest.run(spark, source, out, state))
    for f in Path(state, "commits").glob("*0*"):
        os.remove(f)
    assert _rows(kmer_ingest.run(spark, source, out, state)) == done


def test_batches_of_few_files(spark, tmp_path):
    spark.createDataFrame([(i, "abcdefg" * i) for i in range(12)], "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/in")
    out = kmer_ingest.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", {"files_per_batch": 1})
    assert out.select("batch").distinct().count() == 4 and out.count() == out.select("doc_id").distinct().count() == 12


@pytest.mark.parametrize("name", ["curate_release", "kmer_ingest"])
def test_command_lines(spark, release, tmp_path, name):
    paths = ["--families", release[1]] if name == "curate_release" else ["--checkpoint", f"{tmp_path}/state"]
    config = f"{ROOT}/jobs/{name}.json"
    assert set(json.loads(Path(config).read_text())) == set((curate_release if name == "curate_release" else kmer_ingest).DEFAULTS)
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --conf spark.checkpoint.dir={tmp_path}/shared pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{name}", "--records", release[0], "--out", f"{tmp_path}/cli", "--config", config, *paths], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/cli" + "/records" * (name == "curate_release")).count() > 0


def test_jobs_import_no_operators_for_language_models():
    for p in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        assert not any(line.strip().startswith(("import ", "from ")) and ("kinfold.llm" in line or "corpus_pipeline" in line) for line in p.read_text().splitlines())
