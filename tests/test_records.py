"""Records of large files, of a catalogue, and reports of all rows."""

import pytest
from pyspark.sql import functions as F

from kinfold.sources import formats
from kinfold.sources.records import fetch_new, read_records, record_source

RECORD = "LOCUS       {i} 9 bp\nVERSION     R{i}.1\nFEATURES             Location/Qualifiers\n     CDS             {spot}\n                     /protein_id=\"P{i}\"\nORIGIN\n        1 atgcccgtt\n//\n"


def test_many_records_of_one_file(spark, tmp_path):
    text = "".join(RECORD.format(i=i, spot="1..99999999999" if i == 7 else "1..3") for i in range(400)) + "\n\n"
    (tmp_path / "many.gb").write_text(text)
    (tmp_path / "one.gb").write_text(RECORD.format(i=900, spot="4..6").removesuffix("\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = formats.genbank_records(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        genes, errors = formats.split_errors(formats.genbank_genes(rows))
        got = {r["protein_id"]: (r["nt_sequence"], r["metadata_virus"]["accession"]) for r in genes.collect()}
        assert got == {f"P{i}": ("ATG", f"R{i}.1") for i in range(400) if i != 7} | {"P900": ("CCC", "R900.1")}
        assert ["many.gb" in r["path"] and "R7.1" in r["message"] for r in errors.collect()] == [True]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_earlier_genes_of_a_broken_record_stay(spark):
    text = RECORD.format(i=1, spot="1..3") + RECORD.format(i=2, spot="1..99999999999") + RECORD.format(i=3, spot="1..3")
    genes, errors = formats.split_errors(formats.genbank_genes(spark.createDataFrame([("f", text)], "path string, content string")))
    assert [r["protein_id"] for r in genes.collect()] == ["P1"] and errors.count() == 1


def catalogue(n, notes, bad=()):
    """Notes each request in a file; a local class, so that workers need no module of tests."""

    class Catalogue:
        def count(self):
            return n

        def names(self, start, end):
            return [f"N{i}" for i in range(start, end)]

        def fetch(self, names):
            with open(notes, "a") as f:
                f.write(",".join(names) + "\n")
            with open(notes) as f:
                before = sum(line == ",".join(names) + "\n" for line in f)
            if names[0] in bad and before < 3 or names[0] == "N8":
                raise OSError("busy")
            return {x: x.lower() for x in names if x != "N1"}

    return Catalogue()


def test_catalogue_as_a_table(spark, tmp_path):
    source = record_source(catalogue(10, str(tmp_path / "notes"), ("N4",)), "catalogue_a", size=4, wait=0, pause=0)
    got = {r["accession"]: (r["content"], r["error"]) for r in read_records(spark, source).collect()}
    assert got == {f"N{i}": (f"n{i}", None) for i in (0, 2, 3, 4, 5, 6, 7)} | {"N1": (None, None), "N8": (None, "OSError: busy"), "N9": (None, "OSError: busy")}
    assert sorted((tmp_path / "notes").read_text().split()) == sorted(["N0,N1,N2,N3"] + ["N4,N5,N6,N7"] * 3 + ["N8,N9"] * 3)
    assert read_records(spark, record_source(catalogue(0, str(tmp_path / "notes")), "catalogue_b")).count() == 0


def test_catalogue_as_a_stream_asks_for_the_rest(spark, tmp_path):
    at = [str(tmp_path / x) for x in ("out", "state")]
    for n, asked in ((3, ["N0,N1", "N2"]), (3, []), (6, ["N3,N4", "N5"])):
        notes = tmp_path / f"notes{n}{len(asked)}"
        notes.write_text("")
        out = fetch_new(spark, record_source(catalogue(n, str(notes)), "catalogue_c", size=2, pause=0), *at)
        assert sorted(notes.read_text().split()) == asked
        assert sorted(r["accession"] for r in out.collect()) == [f"N{i}" for i in range(n)]


def test_report_of_all_rows_in_order(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else "x" * (i % 7)) for i in range(1500, 0, -1)]
    formats.write_report(spark.createDataFrame(rows, "a int, long_name string").repartition(4), str(tmp_path / "r"), "Title", ["a"])
    got = [r["value"] for r in spark.read.text(str(tmp_path / "r")).withColumn("f", F.input_file_name()).orderBy("f", F.monotonically_increasing_id()).collect()]
    body = formats.fixed_width([{"a": i, "long_name": s} for i, s in sorted(rows)], "Title").splitlines()
    assert [x.rstrip() for x in got] == body
    formats.write_report(spark.createDataFrame([], "a int"), str(tmp_path / "e"), "T")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "e")).collect()) == ["(no rows)", "T"]


@pytest.mark.parametrize("content", ["", "\n//\n", "no record here\n//\n"])
def test_no_records(spark, tmp_path, content):
    (tmp_path / "x.gb").write_text(content)
    assert formats.genbank_records(spark, str(tmp_path)).count() == 0
