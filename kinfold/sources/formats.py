"""Readers of the line formats, by line number; and writers."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kinfold.functions.sequences import accession_path, id_from_filename, strip
from kinfold.plans.tables import materialize, numbered

GENE_DDL = (
    "protein_id string, product string, nt_sequence string, aa_sequence string, nt_length int, aa_length int, "
    "metadata_virus struct<accession:string,taxon_id:string,organism:string,host:string,taxonomy:array<string>>, "
    "location struct<start:int,end:int,strand:int>, error string"
)


def accession_list(lines: DataFrame, col: str = "value") -> DataFrame:
    """Sorted distinct identifiers of a list with one in each line; blanks go."""
    return lines.select(strip(F.col(col)).alias("accession")).where("accession <> ''").distinct().orderBy("accession")


def missing_files(accessions: DataFrame, files: DataFrame) -> DataFrame:
    """Accessions without a file, by their name with or without a version. ``files`` has path."""
    name = F.regexp_extract("path", r"([^/]+)\.(?i:gb|genbank)$", 1)
    have = files.select(F.explode(F.array(name, F.substring_index(name, ".", 1))).alias("accession")).distinct()
    return accessions.join(have, "accession", "left_anti").withColumn("target", accession_path(F.col("accession")))


def fetch_batches(accessions: DataFrame, fetch, size: int = 100, tries: int = 3, wait: float = 15.0, pause: float = 0.3) -> DataFrame:
    """Rows (accession, content, error) by ``fetch(list of accessions) -> dict``, ``size`` at a time.

    Requests of a task are ``pause`` seconds apart. A failed one is repeated, after ``wait`` seconds
    more each time; then its rows carry the error. ``fetch`` runs on the executors.
    """
    import time

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for a in range(0, len(ids), size):
                part, got, err = ids[a : a + size], {}, None
                time.sleep(pause if a else 0)
                for n in range(1, tries + 1):
                    try:
                        got, err = fetch(part), None
                        break
                    except Exception as e:  # noqa: BLE001
                        err = f"{type(e).__name__}: {e}"
                        time.sleep(wait * n if n < tries else 0)
                yield pa.RecordBatch.from_pydict({"accession": part, "content": [got.get(i) for i in part], "error": [err] * len(part)}, schema=pa.schema([("accession", pa.string()), ("content", pa.string()), ("error", pa.string())]))

    return accessions.select("accession").mapInArrow(run, "accession string, content string, error string")


def scan_files(spark: SparkSession, folder: str, pattern: str = r"\.(gb|genbank)$") -> DataFrame:
    """(path, content) of the files below a folder whose lower-cased name matches."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").rlike(pattern)).select("path", "content")


def genbank_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content): a row for each record of the files at ``path``, wherever in a file it stands.

    Records end with a line of two slashes, by which Spark's text reader cuts files, so that one large file spreads over tasks
    and is never a cell; what has no LOCUS line is no record. Files must end their lines by LF.
    """
    rows = spark.read.option("lineSep", "\n//\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.concat("value", F.lit("\n//\n")).alias("content")).where(F.col("value").rlike("(?m)^LOCUS"))


_FEATURE = re.compile(r"^ {5}(\S+)\s+(.+)$")
_QUALIFIER = re.compile(r"^ {21}/([^=\s]+)(?:=(.*))?$")


def _spans(spot: str) -> list[tuple[int, int, int]]:
    """(start, end, strand) of a location's parts, in the order in which they are read."""
    if m := re.fullmatch(r"(complement|join|order)\((.*)\)", spot):
        if m[1] == "complement":
            return [(a, b, -s) for a, b, s in _spans(m[2])[::-1]]
        parts, depth = [""], 0
        for c in m[2]:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append("")
            else:
                parts[-1] += c
        return [x for p in parts for x in _spans(p)]
    return [(int(a) - 1, int(b or a), 1) for a, b in re.findall(r"<?(\d+)(?:(?:\.\.|\^)>?(\d+))?", spot)]


def parse_genbank(text: str):
    """Gene rows of a GenBank text: one for each CDS feature, with defaults for what is missing."""
    for record in re.split(r"^//\s*$", text, flags=re.M):
        if "LOCUS" not in record:
            continue
        head, _, rest = record.partition("\nFEATURES")
        table, _, origin = rest.partition("\nORIGIN")
        seq = "".join(re.findall(r"[A-Za-z]+", " ".join(line[10:] for line in origin.split("\n")[1:]))).upper()
        version = re.search(r"^VERSION\s+(\S+)", head, re.M) or re.search(r"^ACCESSION\s+(\S+)", head, re.M)
        organism = re.search(r"^SOURCE\s+(.+)$", head, re.M)
        lineage = re.search(r"^ {2}ORGANISM\s+.+\n((?: {12}.*\n?)*)", head, re.M)
        taxonomy = [t.strip(" .\n") for t in " ".join(lineage[1].split()).split(";") if t.strip(" .\n")] if lineage else []
        features, last = [], None
        for line in table.split("\n")[1:]:
            if m := _FEATURE.match(line):
                features.append((m[1], [m[2].strip()], []))
                last = features[-1][1]
            elif m := _QUALIFIER.match(line):
                features[-1][2].append([m[1], m[2] or ""])
                last = features[-1][2][-1]
            elif line.startswith(" " * 21) and last is not None:
                last[-1] += ("" if last[0] == "translation" or len(last) == 1 else " ") + line.strip()
        get = lambda f, name, default: next((v.strip().strip('"') for k, v in f[2] if k == name), default)
        taxon = host = "unknown"
        for f in features:
            if f[0] == "source":
                host = get(f, "host", "unknown")
                for k, v in f[2]:
                    if k == "db_xref" and "taxon:" in v:
                        taxon = v.strip('"').split(":")[-1]
        meta = {"accession": version[1] if version else "unknown", "taxon_id": taxon, "organism": organism[1].strip() if organism else "unknown", "host": host, "taxonomy": taxonomy}
        for f in features:
            if f[0] != "CDS":
                continue
            spot = f[1][0]
            spans = _spans(re.sub(r"[A-Za-z_]+[\d.]*:|\s", "", spot))
            strands = {s for _, _, s in spans}
            strand = strands.pop() if len(strands) == 1 else None  # parts of both strands have none in common
            nt = "".join(seq[a:b] if s == 1 else seq[a:b][::-1].translate(str.maketrans("ACGTUacgtu", "TGCAAtgcaa")) for a, b, s in spans)
            aa = get(f, "translation", "").replace(" ", "")
            yield {"protein_id": get(f, "protein_id", "no_id"), "product": get(f, "product", "unknown"), "nt_sequence": nt, "aa_sequence": aa, "nt_length": len(nt), "aa_length": len(aa), "metadata_virus": meta, "location": {"start": min((a for a, _, _ in spans), default=None), "end": max((b for _, b, _ in spans), default=None), "strand": strand}, "error": None}


def genbank_genes(files: DataFrame) -> DataFrame:
    """Gene documents of (path, content) rows, of files or of single records (``genbank_records``). One that breaks gives
    its genes so far and a row with ``error``; a place beyond 32 bits breaks it."""
    names = [f.split()[0] for f in ("protein_id", "product", "nt_sequence", "aa_sequence", "nt_length", "aa_length", "metadata_virus", "location", "error")]
    meta = pa.struct([("accession", pa.string()), ("taxon_id", pa.string()), ("organism", pa.string()), ("host", pa.string()), ("taxonomy", pa.list_(pa.string()))])
    spot = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("strand", pa.int32())])
    schema = pa.schema(list(zip(names, [pa.string()] * 4 + [pa.int32()] * 2 + [meta, spot, pa.string()])))

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                try:
                    for gene in parse_genbank(content.decode("latin-1")):
                        if max(gene["location"]["end"] or 0, gene["nt_length"], gene["aa_length"]) >= 1 << 31:
                            raise OverflowError(f"a place beyond 32 bits in {gene['metadata_virus']['accession']}")
                        rows.append(gene)
                except Exception as e:  # noqa: BLE001
                    rows.append({n: None for n in names} | {"error": f"{path}: {type(e).__name__}: {e}"})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, GENE_DDL)


def cluster_tsv(lines: DataFrame, pos: str, line: str) -> DataFrame:
    """(member, cluster) of representative-member lines.

    Representatives get dense numbers from 0 by first appearance; a member that comes
    again belongs to its last line; lines of fewer than two columns are skipped.
    """
    parts = F.split(line, "\t")
    rows = lines.where(F.size(parts) >= 2).select(F.col(pos).alias("pos"), strip(parts[0]).alias("rep"), strip(parts[1]).alias("member"))
    reps = numbered(rows.groupBy("rep").agg(F.min("pos").alias("first")), F.col("first"), F.col("rep")).select("rep", F.col("number").alias("cluster"))
    last = rows.groupBy("member").agg(F.max_by("rep", "pos").alias("rep"))
    return last.join(reps, "rep").select("member", "cluster")


def clstr(lines: DataFrame, pos: str, line: str, part: str | None = None) -> DataFrame:
    """(member, cluster) of a greedy clusterer's report: a header's number holds for the lines below.

    Lines before a header and lines without markers are skipped. ``part`` names a
    column that splits independent small files; without it one file's lines are dealt by ranges.
    """
    header = F.regexp_extract(line, r"^>Cluster\s+(\d+)", 1)
    own = F.when(header != "", header.cast("bigint"))
    if part:
        w = Window.partitionBy(part).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        filled = lines.withColumn("cluster", F.last(own, ignorenulls=True).over(w))
    else:
        # a file is dealt by ranges of lines; a range's first lines take the last header of those before
        n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = materialize(lines.repartitionByRange(n, pos).withColumn("_range", F.spark_partition_id()).withColumn("_own", own), "clstr")
        ends = dealt.where("_own is not null").groupBy("_range").agg(F.max_by("_own", pos).alias("_end"))
        ranges = dealt.select("_range").distinct().join(ends, "_range", "left")
        ranges = ranges.select("_range", F.last("_end", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
        w = Window.partitionBy("_range").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        filled = dealt.join(F.broadcast(ranges), "_range").withColumn("cluster", F.coalesce(F.last("_own", ignorenulls=True).over(w), "_before"))  # one row a shuffle partition
    rows = filled.select(F.regexp_extract(line, r">(.*?)\.\.\.", 1).alias("member"), "cluster")
    return rows.where("member <> '' and cluster is not null")


def ortholog_index(lines: DataFrame, line: str) -> DataFrame:
    """(protein, vog) of membership lines: comments, blanks and short lines go.

    A protein counts under its full name and under the part after its first dot.
    """
    parts = F.split(line, "\t")
    rows = lines.where(~F.col(line).startswith("#") & (F.size(parts) >= 5)).select(strip(parts[0]).alias("vog"), F.explode(F.split(parts[4], ",")).alias("p")).select("vog", strip(F.col("p")).alias("p")).where("p <> ''")
    after = F.when(F.instr("p", ".") > 0, F.regexp_extract("p", r"^[^.]*\.(.*)$", 1))
    return rows.select("vog", F.explode(F.array_compact(F.array("p", after))).alias("protein")).where("protein <> ''").groupBy("protein").agg(F.max("vog").alias("vog"))


def read_ortholog_index(spark: SparkSession, path: str) -> DataFrame:
    """The same from a file, gzip or not."""
    return ortholog_index(spark.read.text(path), "value")


def report_members(texts: DataFrame, col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct first words of the lines after the detail marker; rules, blanks and the header go."""
    body = F.regexp_extract(col, r"(?s)DETALLE[^\n]*\n(.*)$", 1)
    lines = texts.select(*keep, F.explode(F.split(body, "\n")).alias("line"))
    first = F.regexp_extract("line", r"^\s*(\S+)", 1)
    return lines.select(*keep, first.alias("member")).where("member <> '' and not member like '===%' and not member like '---%' and member <> 'protein_id'").distinct()


def read_reports(spark: SparkSession, folder: str, pattern: str = "reporte_cluster_*.txt") -> DataFrame:
    """(cluster, cluster_number, text) of all reports in a folder: the identifier in the file's name, as a number where it is one."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).text(folder)
    name, number = id_from_filename(F.input_file_name(), pattern.replace(".", r"\.").replace("*", "(.+)") + "$")
    return raw.select(name.alias("cluster"), number.alias("cluster_number"), F.col("value").alias("text"))


def split_errors(genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(genes, errors): rows that were read, and one row (path, message) for each file that broke."""
    path, message = F.substring_index("error", ": ", 1), F.expr("substring(error, instr(error, ': ') + 2)")
    return genes.where("error is null").drop("error"), genes.where("error is not null").select(path.alias("path"), message.alias("message"))


def collapsed_ids(genes: DataFrame) -> DataFrame:
    """(accession, collapsed): genes without an identifier share one and collapse to a row for each accession; how many are lost."""
    rows = genes.where("protein_id = 'no_id'").groupBy(F.col("metadata_virus.accession").alias("accession")).agg((F.count("*") - 1).alias("collapsed"))
    return rows.where("collapsed > 0")


def fasta_lines(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """FASTA records as text values, sequences in capitals; for ``write.text``."""
    return df.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.upper(seq_col)).alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence) of FASTA files, split by record."""
    raw = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    return raw.select(F.regexp_extract("value", r"^(\S+)", 1).alias("id"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"))


def fixed_width(rows: list[dict], title: str) -> str:
    """A text report of a few collected rows."""
    if not rows:
        return f"{title}\n(no rows)\n"
    heads = list(rows[0])
    width = {h: max(len(h), *(len(str(r[h])) for r in rows)) for h in heads}
    line = lambda r: "  ".join(str(r[h]).ljust(width[h]) for h in heads).rstrip()
    return "\n".join([title, "=" * len(title), line({h: h for h in heads}), *map(line, rows)]) + "\n"


def write_report(df: DataFrame, path: str, title: str, order: Sequence[str] = ()) -> None:
    """A fixed-width text file of all rows in ``order`` (else in that of their columns), written by Spark.

    Column widths are an aggregate; lines are made by expressions and sorted over ranges, in as many files.
    """
    spark, names = df.sparkSession, df.columns
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(f"_{c}") for c in names], *[F.col(c) for c in (order or names)])
    wide = text.agg(*[F.max(F.length(f"_{c}")).alias(c) for c in names]).first()
    if wide[0] is None:
        rows = spark.createDataFrame([(title,), ("(no rows)",)], "value string").coalesce(1)
    else:
        width = {c: max(len(c), wide[c]) for c in names}
        line = F.rtrim(F.concat_ws("  ", *[F.rpad(f"_{c}", width[c], " ") for c in names]))
        head = [title, "=" * len(title), "  ".join(c.ljust(width[c]) for c in names).rstrip()]
        body = materialize(text.select(*(order or names), line.alias("value")).orderBy(*(order or names)).select("value"), "report")
        rows = spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).union(body)
    rows.write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV files, one for each call, for small tables; every file has its header, which readers skip."""
    df.coalesce(1).write.mode(mode).option("header", "true").csv(path)
