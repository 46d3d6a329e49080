"""Queries of sources, curation, profiles, joins and write modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions.sequences import accession_path, base_id, hypothetical, nonempty, strip, text_between
from kinfold.operators import curation as cur, features as fs, kmers as km
from kinfold.plans.registry import query
from kinfold.plans.tables import shared_dir, table as T
from kinfold.sources import formats as fmt, records as rec


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars BETWEEN 30 AND 1175")
def curate_length_range(spark, d):
    return cur.curate(T(spark, d, "documents"), "n_chars").select("doc_id", "lang", "source", "n_chars")


@query("""SELECT count(*) AS original, count(*) FILTER (n_chars BETWEEN 30 AND 1175) AS curated,
    count(*) - count(*) FILTER (n_chars BETWEEN 30 AND 1175) AS removed,
    CASE WHEN count(*) > 0 THEN round((count(*) - count(*) FILTER (n_chars BETWEEN 30 AND 1175)) * 100.0::DOUBLE / count(*), 2) ELSE 0.0::DOUBLE END AS percent_removed FROM documents""")
def curation_summary(spark, d):
    return cur.removal_report(T(spark, d, "documents"), "n_chars")


@query("""SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min,
    round(quantile_cont(n_chars, 0.25), 6) AS q25, round(quantile_cont(n_chars, 0.5), 6) AS q50, round(quantile_cont(n_chars, 0.75), 6) AS q75, max(n_chars) AS max FROM documents""")
def length_describe(spark, d):
    return cur.describe(T(spark, d, "documents"), "n_chars")


@query("SELECT round(quantile_cont(n_chars, 0.95), 6) AS quantile FROM documents")
def length_quantile95(spark, d):
    return cur.quantile(T(spark, d, "documents"), "n_chars")


@query("""WITH s AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents)
    SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 100)), 99) AS BIGINT) AS bin, count(*) AS n FROM documents, s GROUP BY 1""")
def length_histogram_100(spark, d):
    return cur.histogram(T(spark, d, "documents"), "n_chars")


@query("""WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3 FROM documents),
    r AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
    SELECT round(max(q1), 6) AS q1, round(max(q2), 6) AS q2, round(max(q3), 6) AS q3, min(n_chars) FILTER (n_chars BETWEEN lo AND hi) AS whisker_low,
    max(n_chars) FILTER (n_chars BETWEEN lo AND hi) AS whisker_high, count(*) FILTER (n_chars NOT BETWEEN lo AND hi) AS outliers FROM documents, r""")
def boxplot_outliers(spark, d):
    return cur.boxplot(T(spark, d, "documents"), "n_chars")


@query("""WITH s AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi, quantile_cont(n_chars, 0.95) AS most FROM documents),
    b AS (SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 100)), 99) AS BIGINT) AS bin, count(*) AS n FROM documents, s GROUP BY 1)
    SELECT bin, n, round(lo + bin * (hi - lo) / 100, 6) AS start FROM b, s WHERE lo + bin * (hi - lo) / 100 <= most""")
def length_histogram_clipped(spark, d):
    return cur.clipped_histogram(T(spark, d, "documents"), "n_chars")


@query("""WITH s AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi, stddev_samp(n_chars) AS sd, count(n_chars) AS m FROM documents),
    b AS (SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 400)), 399) AS BIGINT) AS bin, count(*) AS n FROM documents, s GROUP BY 1),
    g AS (SELECT CAST(r.i AS INT) AS i, lo + (hi - lo) * r.i / 49 AS x, lo, hi, m, sd * m ^ (-0.2::DOUBLE) AS h FROM s, range(0, 50) AS r(i))
    SELECT i, round(sum(n * exp(-0.5::DOUBLE * (((x - lo - (hi - lo) * (bin + 0.5::DOUBLE) / 400) / h) ^ 2)) / (h * sqrt(2 * pi())) / m), 9) AS density, round(max(x), 6) AS x FROM g, b GROUP BY 1""")
def length_density(spark, d):
    return cur.kernel_density(T(spark, d, "documents"), "n_chars")


@query("SELECT source AS key, count(*) AS n FROM documents GROUP BY 1")
def organism_counts(spark, d):
    return cur.group_counts(T(spark, d, "documents"), "source")


@query("SELECT source AS key, count(*) AS n FROM documents WHERE n_chars BETWEEN 30 AND 1175 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def top_organisms(spark, d):
    return cur.top_k(cur.curate(T(spark, d, "documents"), "n_chars"), "source", 15)


def hosts(spark, d):
    c, n = T(spark, d, "customer"), T(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))


@query("SELECT n_name AS key, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_hosts(spark, d):
    return cur.top_k(hosts(spark, d), "n_name", 10)


@query("""WITH t AS (SELECT n_name AS key, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
    SELECT key, n, round(n / sum(n) OVER (), 6) AS share FROM t""")
def host_share(spark, d):
    return cur.shares_of_top(hosts(spark, d), "n_name", 10)


@query("SELECT round(avg(n_chars), 6) AS mean_length, min(n_chars) AS min_length, max(n_chars) AS max_length FROM documents")
def length_summary(spark, d):
    return T(spark, d, "documents").agg(F.round(F.avg("n_chars"), 6).alias("mean_length"), F.min("n_chars").alias("min_length"), F.max("n_chars").alias("max_length"))


@query("SELECT doc_id, length(text) AS len FROM documents WHERE coalesce(length(text), 0) > 0")
def truthy_filter(spark, d):
    return T(spark, d, "documents").where(nonempty(F.col("text"))).select("doc_id", F.length("text").cast("bigint").alias("len"))


@query("SELECT p_partkey AS protein_id, p_name AS product FROM part WHERE p_name IS NOT NULL AND p_name <> ''")
def nonempty_annotation(spark, d):
    return T(spark, d, "part").where(nonempty(F.col("p_name"))).select(F.col("p_partkey").alias("protein_id"), F.col("p_name").alias("product"))


@query("SELECT x AS product, coalesce(regexp_matches(lower(x), 'hypothetical|uncharacterized|unknown'), false) AS hypothetical FROM (SELECT p_name AS x FROM part UNION ALL VALUES ('Hypothetical protein'), ('UNKNOWN'), (NULL), ('capsid'))")
def hypothetical_regex(spark, d):
    extra = spark.createDataFrame([("Hypothetical protein",), ("UNKNOWN",), (None,), ("capsid",)], "product string")
    return T(spark, d, "part").select(F.col("p_name").alias("product")).union(extra).withColumn("hypothetical", hypothetical(F.col("product")))


@query("""SELECT o_orderkey, substr(a, 1, 2) || '/' || CASE WHEN length(a) > 5 THEN substr(a, 4, 2) ELSE '00' END || '/' || a || '.gb' AS path
    FROM (SELECT o_orderkey, 'NC_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS a FROM orders)""")
def accession_paths(spark, d):
    a = F.concat(F.lit("NC_"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    return T(spark, d, "orders").select("o_orderkey", accession_path(a).alias("path"))


@query("SELECT DISTINCT trim(c_mktsegment) AS accession FROM customer WHERE trim(c_mktsegment) <> '' ORDER BY 1")
def accession_list(spark, d):
    return fmt.accession_list(T(spark, d, "customer").select(F.concat(F.lit(" \t"), "c_mktsegment", F.lit(" ")).alias("value")))


@query("""SELECT doc_id, regexp_replace(text, '[UZOB]', 'X', 'g') AS clean, split_part(source, '.', 1) AS base, lower(substr(text, 3, 4)) AS slice FROM documents""")
def residue_cleaning(spark, d):
    return T(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[UZOB]", "X").alias("clean"), base_id(F.col("source")).alias("base"), F.lower(F.substring("text", 3, 4)).alias("slice"))


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, trim(url) AS url FROM pages")
def between_markers(spark, d):
    return T(spark, d, "pages").select("page_id", text_between(F.col("html"), "<title>", "</title>").alias("title"), strip(F.col("url")).alias("url"))


def _kmer_sql(k: int) -> str:
    return f"""SELECT id, CAST({k} AS INT) AS k, kmer, n, round(n / (len - {k} + 1), 6) AS freq FROM (SELECT doc_id AS id, length(text) AS len, substr(text, CAST(i AS BIGINT), {k}) AS kmer, count(*) AS n
        FROM documents, range(1, length(text) - {k} + 2) AS r(i) WHERE length(text) >= {k} GROUP BY 1, 2, 3)"""


@query(_kmer_sql(5))
def kmer_profile_5(spark, d):
    return km.kmer_counts(T(spark, d, "documents"), "doc_id", "text", [5]).withColumn("freq", F.round("freq", 6))


@query(_kmer_sql(6))
def kmer_profile_6(spark, d):
    return km.kmer_counts(T(spark, d, "documents"), "doc_id", "text", [6]).withColumn("freq", F.round("freq", 6))


@query()
def kmer_vocab_by_k(spark, d):
    return km.k_statistics_of(T(spark, d, "documents"), "doc_id", "text", range(3, 9))


@query("""SELECT substr(text, CAST(i AS BIGINT), 3) AS key, count(*) AS n FROM documents, range(1, length(text) - 1) AS r(i) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def kmer_top(spark, d):
    return km.kmer_totals(T(spark, d, "documents"), "text", [3]).select(F.col("kmer").alias("key"), "n").orderBy(F.desc("n"), "key").limit(50)


@query("""WITH v AS (SELECT DISTINCT substr(text, CAST(i AS BIGINT), 3) AS kmer FROM documents, range(1, length(text) - 1) AS r(i))
    SELECT CAST(3 AS INT) AS k, kmer, CAST(row_number() OVER (ORDER BY kmer COLLATE "C") - 1 AS INT) AS col FROM v""")
def kmer_vocabulary(spark, d):
    return km.vocabulary(km.kmer_totals(T(spark, d, "documents"), "text", [3]))


_SEEN = """(SELECT kmer, CAST(row_number() OVER (ORDER BY id, pos) - 1 AS BIGINT) AS col FROM (SELECT substr(text, CAST(i AS BIGINT), 4) AS kmer, arg_min(doc_id, doc_id * 1000000 + i) AS id, min(doc_id * 1000000 + i) - arg_min(doc_id, doc_id * 1000000 + i) * 1000000 AS pos
    FROM documents, range(1, length(text) - 2) AS r(i) WHERE n_chars BETWEEN 30 AND 1175 GROUP BY 1))"""


@query(f"SELECT kmer, col FROM {_SEEN}")
def kmer_first_seen(spark, d):
    """Columns in the order of first appearance, which a dictionary that grows row by row would give."""
    return km.first_seen_vocabulary(cur.curate(T(spark, d, "documents"), "n_chars"), "doc_id", "text", 4)


@query(f"""WITH c AS (SELECT doc_id AS id, substr(text, CAST(i AS BIGINT), 4) AS kmer, count(*) / max(length(text) - 3) AS freq FROM documents, range(1, length(text) - 2) AS r(i) WHERE n_chars BETWEEN 30 AND 1175 GROUP BY 1, 2)
    SELECT id, CAST(4 AS INT) AS k, col, round(freq, 9) AS freq FROM c JOIN {_SEEN} USING (kmer)""")
def kmer_sparse_matrix(spark, d):
    """The matrix in long form, over those columns."""
    docs = cur.curate(T(spark, d, "documents"), "n_chars")
    vocab = km.first_seen_vocabulary(docs, "doc_id", "text", 4).withColumn("k", F.lit(4))
    return km.sparse_rows(km.kmer_counts(docs, "doc_id", "text", [4]), vocab).withColumn("freq", F.round("freq", 9))


@query()
def kmer_maps(spark, d):
    return km.kmer_maps(cur.curate(T(spark, d, "documents"), "n_chars"), "doc_id", "text", [5, 6])


@query("""SELECT d.doc_id AS protein_id, source AS product, CAST(quality AS INT) AS quality, CAST(label AS INT) AS cluster, CAST(length(url) AS INT) AS url, CAST(length(b.text) AS INT) AS item
    FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id JOIN pages p ON p.page_id = d.doc_id JOIN benchmark b ON b.item_id = d.doc_id WHERE source IS NOT NULL AND source <> ''""")
def unified_features_inner(spark, d):
    base = T(spark, d, "documents").select(F.col("doc_id").alias("protein_id"), F.col("source").alias("product"))
    one = T(spark, d, "labels").select(F.col("doc_id").alias("protein_id"), "quality")
    two = T(spark, d, "embeddings").select(F.col("vec_id").alias("protein_id"), F.col("label").alias("cluster"))
    three = T(spark, d, "pages").select(F.col("page_id").alias("protein_id"), F.length("url").alias("url"))
    four = T(spark, d, "benchmark").select(F.col("item_id").alias("protein_id"), F.length("text").alias("item"))
    return fs.unified_features(base, [one, two, three, four], "protein_id", "product")


@query("""SELECT doc_id, n_chars, coalesce(CAST(q AS VARCHAR), 'Desconocido') AS quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)""")
def annotation_left_default(spark, d):
    return fs.with_annotation(T(spark, d, "documents").select("doc_id", "n_chars"), T(spark, d, "labels"), "doc_id", "quality")


@query("""SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100)""")
def semi_sample(spark, d):
    return T(spark, d, "documents").select("doc_id", "lang").join(cur.sample_rows(T(spark, d, "labels"), "doc_id", 100).select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_resume(spark, d):
    return fs.pending(T(spark, d, "documents").select("doc_id", "n_chars"), T(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, CAST(coalesce(q, -1) AS INT) AS quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)")
def lookup_minus_one(spark, d):
    lab = T(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    return fs.lookup(T(spark, d, "documents").select("doc_id"), lab, "doc_id", "quality")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_key(spark, d):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return fs.last_wins(T(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN upper(replace(text, 'ß', 'SS')) ELSE text END AS text, role FROM conversations
    UNION ALL SELECT -1 - conv_id, turn, text, role FROM conversations WHERE role = 'user'""")
def upsert_last_wins(spark, d):
    old = T(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    user = old.where("role = 'user'")
    new = user.withColumn("text", F.upper("text")).unionByName(user.withColumn("conv_id", -1 - F.col("conv_id")))
    return fs.upsert(old, new, ["conv_id", "turn"])


@query("SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT (l_orderkey, l_linenumber)) AS lines, count(*) AS n FROM lineitem")
def distinct_ids(spark, d):
    return T(spark, d, "lineitem").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_orderkey", "l_linenumber").alias("lines"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_id AS pos, 'u' || user_id AS rep, 'e' || (event_id % 1000) AS member FROM events),
    f AS (SELECT rep, dense_rank() OVER (ORDER BY min(pos)) - 1 AS cluster FROM r GROUP BY rep), l AS (SELECT member, arg_max(rep, pos) AS rep FROM r GROUP BY member)
    SELECT member, cluster FROM l JOIN f USING (rep)""")
def dense_id_first_seen(spark, d):
    line = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("\te"), F.pmod("event_id", F.lit(1000)).cast("string"))
    return fmt.cluster_tsv(T(spark, d, "events").select("event_id", line.alias("line")), "event_id", "line")


@query("""WITH h AS (SELECT event_id, user_id % 16 AS f, CASE WHEN event_type = 'signup' THEN event_id END AS h FROM events),
    g AS (SELECT event_id, f, max(h) OVER (PARTITION BY f ORDER BY event_id) AS cluster, h FROM h)
    SELECT 'P' || event_id AS member, cluster FROM g WHERE h IS NULL AND cluster IS NOT NULL""")
def header_forward_fill(spark, d):
    e = T(spark, d, "events")
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit(">Cluster "), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("0\t10aa, >P"), F.col("event_id").cast("string"), F.lit("... *")))
    return fmt.clstr(e.select("event_id", F.pmod("user_id", F.lit(16)).alias("f"), line.alias("line")), "event_id", "line", "f")


def _vog_lines(spark, d):
    i = F.col("item_id")
    line = F.concat_ws("\t", F.concat(F.lit("VOG"), F.pmod(i, F.lit(7)).cast("string")), F.lit("2"), F.lit("2"), F.lit("Xu"), F.concat(F.lit("9."), F.lit("VP_"), i.cast("string"), F.lit(",VQ_"), i.cast("string"), F.lit(".1")))
    lines = T(spark, d, "benchmark").select(line.alias("value"))
    return lines.union(spark.createDataFrame([("#GroupName\tx\tx\tx\tx",), ("",), ("short\tline",)], "value string"))


_VOG = """(SELECT protein, max(vog) AS vog FROM (SELECT 'VOG' || (item_id % 7) AS vog, unnest(['9.VP_' || item_id, 'VP_' || item_id, 'VQ_' || item_id || '.1', '1']) AS protein FROM benchmark) GROUP BY 1)"""


@query(f"SELECT protein, vog FROM {_VOG}")
def ortholog_explode(spark, d):
    return fmt.ortholog_index(_vog_lines(spark, d), "value")


_MEMBERS = "(SELECT doc_id, lang AS cluster, CASE WHEN doc_id % 3 = 0 THEN 'VP_' || (doc_id % 60) WHEN doc_id % 3 = 1 THEN 'VP_' || (doc_id % 60) || '.2' ELSE 'X' || doc_id END AS protein FROM documents)"


def _members(spark, d):
    i, r = F.col("doc_id"), F.pmod("doc_id", F.lit(3))
    m = F.pmod(i, F.lit(60)).cast("string")
    p = F.when(r == 0, F.concat(F.lit("VP_"), m)).when(r == 1, F.concat(F.lit("VP_"), m, F.lit(".2"))).otherwise(F.concat(F.lit("X"), i.cast("string")))
    return T(spark, d, "documents").select("doc_id", F.col("lang").alias("cluster"), p.alias("protein"))


_FALLBACK = f"""SELECT m.doc_id, m.cluster, m.protein, coalesce(a.vog, b.vog, 'Desconocido/Novel') AS vog FROM {_MEMBERS} m
    LEFT JOIN {_VOG} a ON a.protein = m.protein LEFT JOIN {_VOG} b ON b.protein = split_part(m.protein, '.', 1)"""


@query(_FALLBACK)
def ortholog_fallback(spark, d):
    return fs.fallback_lookup(_members(spark, d), fmt.ortholog_index(_vog_lines(spark, d), "value"), "protein", "protein", "vog").select("doc_id", "cluster", "protein", "vog")


@query(f"""WITH m AS ({_FALLBACK}), g AS (SELECT cluster, vog, count(*) AS n FROM m GROUP BY 1, 2),
    r AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS size, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, vog) AS rn FROM g)
    SELECT cluster AS cluster_id, CAST(max(size) AS BIGINT) AS size, max(vog) FILTER (rn = 1) AS dominant, max(n) AS dominant_n, round(max(n / size), 4) AS purity, count(*) AS distinct_values FROM r GROUP BY 1""")
def ortholog_purity(spark, d):
    from kinfold.operators.metrics import purity_entropy

    return purity_entropy(ortholog_fallback(spark, d), "cluster", "vog").drop("entropy")


@query(f"""WITH m AS (SELECT * FROM ({_FALLBACK}) WHERE vog <> 'Desconocido/Novel'), g AS (SELECT cluster, vog, count(*) AS n FROM m GROUP BY 1, 2),
    r AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS size, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, vog) AS rn FROM g)
    SELECT cluster AS cluster_id, CAST(max(size) AS BIGINT) AS size, max(vog) FILTER (rn = 1) AS dominant, max(n) AS dominant_n, round(max(n / size), 4) AS purity, count(*) AS distinct_values FROM r GROUP BY 1""")
def ortholog_purity_annotated(spark, d):
    """The same of members with a known group alone; without any, no rows."""
    from kinfold.operators.metrics import purity_entropy

    return purity_entropy(ortholog_fallback(spark, d).where(F.col("vog") != fs.NOVEL), "cluster", "vog").drop("entropy")


@query(f"SELECT count(*) AS members, count(*) FILTER (vog <> 'Desconocido/Novel') AS matched FROM ({_FALLBACK})")
def ortholog_matches(spark, d):
    return ortholog_fallback(spark, d).agg(F.count("*").alias("members"), F.count_if(F.col("vog") != fs.NOVEL).alias("matched"))


@query("""SELECT DISTINCT lang, split_part(trim(l), ' ', 1) AS member FROM (SELECT lang, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '\\S')
    AND NOT starts_with(split_part(trim(l), ' ', 1), '===') AND NOT starts_with(split_part(trim(l), ' ', 1), '---') AND split_part(trim(l), ' ', 1) <> 'protein_id'""")
def report_members(spark, d):
    text = F.concat(F.lit("REPORTE\nDETALLE DE MIEMBROS\n=====\nprotein_id product\n"), F.col("text"))
    return fmt.report_members(T(spark, d, "documents").select("lang", text.alias("text")), "text", ("lang",))


@query("SELECT '>' || doc_id || chr(10) || upper(replace(text, 'ß', 'SS')) AS value FROM documents WHERE n_chars BETWEEN 30 AND 1175")
def fasta_export(spark, d):
    return fmt.fasta_lines(cur.curate(T(spark, d, "documents"), "n_chars"), "doc_id", "text")


GENBANK = "LOCUS       {acc} {n} bp DNA\nACCESSION   {acc}\nVERSION     {acc}.1\nSOURCE      {org}\n  ORGANISM  {org}\n            Viruses; {org}.\nFEATURES             Location/Qualifiers\n     source          1..9\n                     /host=\"{host}\"\n                     /db_xref=\"taxon:{tax}\"\n     CDS             1..6\n                     /protein_id=\"P{acc}\"\n                     /product=\"{host}\"\n                     /translation=\"MKV\"\nORIGIN\n        1 atgaaagtt\n//\n"


_GENES = """SELECT 'PS' || s_suppkey AS protein_id, s_name AS product, 'ATGAAA' AS nt_sequence, 'MKV' AS aa_sequence, 'S' || s_suppkey || '.1' AS accession, CAST(s_nationkey AS VARCHAR) AS taxon_id, 'org' AS organism, s_name AS host, 1 AS strand FROM supplier"""


def _genbank_texts(spark, d):
    """(name, text): a record for each supplier."""
    s = T(spark, d, "supplier")
    text = F.lit(GENBANK)
    for k, v in (("{acc}", F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))), ("{n}", F.lit("9")), ("{org}", F.lit("org")), ("{host}", F.col("s_name")), ("{tax}", F.col("s_nationkey").cast("string"))):
        text = F.replace(text, F.lit(k), v)
    return s.select(F.col("s_name").alias("path"), text.alias("content"))


def _gene_columns(genes):
    return genes.select("protein_id", "product", "nt_sequence", "aa_sequence", "metadata_virus.accession", "metadata_virus.taxon_id", "metadata_virus.organism", "metadata_virus.host", "location.strand")


@query(_GENES)
def genbank_parse(spark, d):
    return _gene_columns(fmt.genbank_genes(_genbank_texts(spark, d)))


@query(_GENES)
def genbank_many_records(spark, d):
    """The same records from a few files of many records, read record by record."""
    import uuid

    path = f"{shared_dir(spark)}/kinfold/genbank-{uuid.uuid4().hex}"
    _genbank_texts(spark, d).select(F.regexp_replace("content", "\n$", "").alias("value")).coalesce(2).write.text(path)
    genes, errors = fmt.split_errors(fmt.genbank_genes(fmt.genbank_records(spark, path)))
    return _gene_columns(genes)


class SupplierRecords:
    """A catalogue of a record for each number of a supplier."""

    def __init__(self, n: int):
        self.n = n

    def count(self) -> int:
        return self.n

    def names(self, start: int, end: int) -> list[str]:
        return [f"S{i}" for i in range(start, end)]

    def fetch(self, names: list[str]) -> dict[str, str]:
        return {x: f"LOCUS       {x}" for x in names}


@query("SELECT 'S' || s_suppkey AS accession, 'LOCUS       S' || s_suppkey AS content, s_name AS name FROM supplier")
def fetched_records(spark, d):
    """Records asked for in batches by a data source, joined to their table; twice, from the checkpoint on."""
    import uuid

    s, at = T(spark, d, "supplier"), f"{shared_dir(spark)}/kinfold/fetched-{uuid.uuid4().hex}"
    n = s.agg(F.coalesce(F.max("s_suppkey") + 1, F.lit(0))).first()[0]
    for part in (n // 2, n):
        got = rec.fetch_new(spark, rec.record_source(SupplierRecords(part), "supplier_records", size=7, pause=0), f"{at}/records", f"{at}/checkpoint")
    return got.join(s.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("accession"), F.col("s_name").alias("name")), "accession").select("accession", "content", "name")


@query("SELECT key AS id FROM (SELECT doc_id AS key FROM documents INTERSECT SELECT doc_id FROM labels)")
def id_intersection(spark, d):
    return T(spark, d, "documents").select(F.col("doc_id").alias("id")).intersect(T(spark, d, "labels").select("doc_id"))


@query("SELECT 'orders' AS strategy, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def result_union(spark, d):
    one = lambda n: T(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("strategy"), "n")
    return one("orders").unionByName(one("events"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_counts(spark, d):
    from kinfold.streaming.ingest import windowed_counts as wc

    return wc(T(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_incremental(spark, d):
    import uuid

    from kinfold.plans.tables import shared_dir
    from kinfold.streaming.ingest import ingest

    base = f"{shared_dir(spark)}/kinfold/stream-{uuid.uuid4().hex}"
    events = T(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts")
    events.write.parquet(f"{base}/in")
    schema = events.schema
    for _ in range(2):
        t = ingest(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ck", ["event_id"], ["ts"])
        events.write.mode("append").parquet(f"{base}/in")
    return t.read().select("event_id", "user_id", "event_type", "value")
