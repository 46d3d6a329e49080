"""Sequence and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip(s: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def nonempty(s: Column) -> Column:
    """True for strings with content; null counts as empty."""
    return F.coalesce(F.length(s) > 0, F.lit(False))


def kmers(sequence: Column, k: int | Column) -> Column:
    """All overlapping substrings of length k; none if the sequence is shorter."""
    k = F.lit(k) if isinstance(k, int) else k
    # every position looks ahead and then takes one character, so the scan is linear in the text
    ahead = F.concat(F.lit("(?s)(?=(.{"), k.cast("string"), F.lit("}))."))
    return F.regexp_extract_all(sequence, ahead, F.lit(1))


def padded_hamming(a: Column, b: Column) -> Column:
    """(Mismatches over the common length + difference in length) / longer length; 0 for two empty ones."""
    letters = lambda s: F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))
    wrong = F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: ~x.eqNullSafe(y)), lambda z: z))
    return wrong / F.greatest(F.length(a), F.length(b), F.lit(1))


def accession_path(accession: Column, base: str = "", suffix: str = ".gb") -> Column:
    """prefix / two characters after the third / accession: files spread over folders."""
    sub = F.when(F.length(accession) > 5, F.substring(accession, 4, 2)).otherwise("00")
    path = F.concat(F.substring(accession, 1, 2), F.lit("/"), sub, F.lit("/"), accession, F.lit(suffix))
    return F.concat(F.lit(base.rstrip("/") + "/"), path) if base else path


def mask_rare_residues(sequence: Column) -> Column:
    """Upper case, with the residues U, Z, O and B as X, and spaces between residues."""
    clean = F.regexp_replace(F.upper(sequence), "[UZOB]", "X")
    return F.regexp_replace(clean, "(?s)(.)(?=.)", "$1 ")


def hypothetical(product: Column) -> Column:
    """Whether an annotation says that nothing is known; null says nothing."""
    return F.coalesce(F.lower(product).rlike("hypothetical|uncharacterized|unknown"), F.lit(False))


def base_id(identifier: Column) -> Column:
    """An identifier up to its first dot."""
    return F.substring_index(identifier, ".", 1)


def text_between(s: Column, left: str, right: str) -> Column:
    """What stands between two markers (regular expressions), or empty."""
    return F.regexp_extract(s, f"{left}(.*?){right}", 1)


def id_from_filename(name: Column, pattern: str = r"reporte_cluster_(.+)\.txt$") -> tuple[Column, Column]:
    """The identifier in a file's name as text, and as a number where it is one."""
    text = F.regexp_extract(name, pattern, 1)
    return text, text.try_cast("bigint")
