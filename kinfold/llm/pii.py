"""Operator 7, PII: surrogate generation, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.plans.tables import discard, materialize

#: What follows a title: up to four capitalised words, with hyphens and apostrophes.
NAME = r"\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,3}"
#: Entity types and what detects them, the more specific first.
DETECTORS: dict[str, str] = {
    "password": r"://[^\s:@/]{1,64}:[^\s:@/]{1,128}@",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "pem": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+){0,400}+-----END [A-Z ]{0,30}PRIVATE KEY-----",
    "token": r"(?<![\p{L}\p{N}])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}|xox[abprs]-[0-9A-Za-z-]{10,250}|sk-[0-9A-Za-z_-]{20,250}|eyJ[0-9A-Za-z_-]{8,2000}\.eyJ[0-9A-Za-z_-]{4,4000}\.[0-9A-Za-z_-]{4,2000})(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,128}(?![\p{L}\p{N}])",
    "mac": r"(?<![\p{L}\p{N}:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\p{L}\p{N}:-])",
    "ipv6": r"(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{3})(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ip": r"(?<![\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![\p{N}])|(?<![\p{N}])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![\p{N}])|(?<![\p{L}\p{N}])[0-9]{13,19}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "person_f": r"(?<![\p{L}])(?:Mrs|MRS|Ms|MS|Miss|MISS|Frau|FRAU|Madame|MADAME|Mme|MME|Señora|SEÑORA|Sra|SRA|Г-жа|Г-ЖА)" + NAME,
    "person_m": r"(?<![\p{L}])(?:Mr|MR|Sir|SIR|Herr|HERR|Monsieur|MONSIEUR|Señor|SEÑOR|Sr|SR|Г-н|Г-Н)" + NAME,
    "person_n": r"(?<![\p{L}])(?:Dr|DR|Prof|PROF)" + NAME,
}
#: What the first characters of some types are, so that most positions fail one test and not one for each type.
GROUPS = (("", ("password", "email", "pem")), (r"(?<![\p{L}\p{N}])(?=[0-9A-Za-z:])", ("token", "secret", "mac", "ipv6", "iban")), (r"(?=[0-9+(])", ("ip", "phone", "card", "ssn")), (r"(?=[MFSHГDP])", ("person_f", "person_m", "person_n")))
PATTERN = "|".join(f"{guard}(?:{'|'.join(f'(?:{DETECTORS[k]})' for k in kinds)})" for guard, kinds in GROUPS)

#: Letters that stand for letters, by script; each keeps its own kind.
KINDS = {"vowel": "aeiou", "consonant": "bcdfghklmnprstvz", "cyrillic_vowel": "аеиоуя", "cyrillic_consonant": "бвгдзклмнпрст", "greek": "αβγδεικλμνορστυω", "accented": "áéíóúàèâêôäöü", "digit": "0123456789", "upper": "ABCDEFGHJKLMNPQRSTUVWXYZ", "hex": "0123456789abcdef"}
#: Letters for scripts without a table of kinds, by Unicode script; any other letter becomes one of the last.
SCRIPTS = {"Han": "安白成大方高光海河华金林明南平青山石水松天文星雪阳云中竹", "Hangul": "가나다라마바사아자차카타파하강김남박송신오윤임장정조한", "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにのはひふへほまみも", "Katakana": "アイウエオカキクケコサシスセソタチツテトナニノハヒフヘホマミモ", "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "Arabic": "ابتجحدرزسشصضطعفقكلمنهوي", "Devanagari": "कखगचजटडतदनपबमयरलवशसह", "Thai": "กขคงจชซดตถทนบปพมยรลวสห", "Latin": "áéíóúàèâêôäöü"}
_MEMBERS = {"vowel": "aeiouy", "consonant": "bcdfghjklmnpqrstvwxz", "cyrillic_vowel": "аеёиоуыэюя", "cyrillic_consonant": "бвгджзйклмнпрстфхцчшщьъ", "greek": "αβγδεζηθικλμνξοπρσςτυφχψω", "digit": "0123456789"}
SEPARATORS = r"[ ().-]"
ATTEMPTS = 8  # draws of an entity's own length; each further one is a character longer, where its type allows
MOST_ATTEMPTS = 64  # then a type has run out of surrogates, which is an error


PERSONS = ("person_f", "person_m", "person_n")
EXACT = ("pem", "password", "token")
#: What says the kind of a key, and stays.
KEY_PREFIX = r"^(-----BEGIN [A-Z ]*-----|AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|eyJ|://[^:]*:)"


def kind_of(entity: Column) -> Column:
    """The type of a detected string: the first detector that takes it whole."""
    out = F.lit(None).cast("string")
    for name, p in reversed(DETECTORS.items()):
        out = F.when(entity.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    """What all spellings of one entity share: lower case, no separators in numbers, no title of a
    person. The letters of keys and passwords have no other spelling."""
    low = F.lower(entity)
    numbers = F.when(kind.isin("phone", "card", "ssn", "iban"), F.regexp_replace(low, SEPARATORS, ""))
    return numbers.when(kind.isin(*PERSONS), F.substring(low, _title(entity) + 1, F.length(low))).when(kind.isin(*EXACT), entity).otherwise(low)


def _title(entity: Column) -> Column:
    return F.length(F.regexp_extract(entity, r"^(\S+ )", 1))


def _kept_prefix(kind: Column, name: Column) -> Column:
    """Leading characters that say the type and not the person: country codes, issuer, kind of key."""
    plus = F.when(name.startswith("+"), F.lit(2)).otherwise(F.lit(0))
    own = F.when(kind.isin(*EXACT), F.length(F.regexp_extract(name, KEY_PREFIX, 1)))
    return own.when(kind == "phone", plus).when(kind == "card", F.lit(1)).when(kind == "iban", F.lit(2)).otherwise(F.lit(0))


def _pick(chars: str, n: Column) -> Column:
    return F.substring(F.lit(chars), F.pmod(n, F.lit(len(chars))).cast("int") + 1, F.lit(1))


def _growth(kind: Column, name: Column) -> Column:
    """The number of characters before the place where a surrogate may grow: of a personal name
    before its last letter, of an address at the end of its local part, of a phone number or key at
    the end, of a PEM block before its end mark. Null for the other types: those have millions of surrogates at any
    length, but for short forms of IPv6, which give way to full ones."""
    end = F.length(F.regexp_extract(name, r"(-----END [A-Z ]*-----)$", 1))
    own = F.when(kind.isin(*PERSONS), F.length(name) - 1).when(kind == "password", F.length(name) - 1).when(kind == "email", F.instr(name, "@") - 1)
    return own.when(kind.isin("phone", "token"), F.length(name)).when(kind == "pem", F.length(name) - end)


def _beyond(kind: Column, name: Column, attempt: Column) -> Column:
    """How many characters an attempt is longer than its entity, where that may grow: a key or password without a
    letter or digit to replace grows from the first attempt."""
    free = F.substring(name, _kept_prefix(kind, name) + 1, F.length(name))
    fixed = kind.isin(*EXACT) & ~F.regexp_replace(free, "-----END [A-Z ]*-----$", "").rlike(r"[\p{L}\p{N}]")
    return F.when(fixed, attempt + 1).otherwise(attempt - ATTEMPTS + 1)


def surrogate(kind: Column, name: Column, attempt: Column, key: str) -> Column:
    """The keyed stand-in of a canonical entity, of the same type, script and format.

    A keyed SHA-512 drives every character: digits become digits, hexadecimal ones
    hexadecimal, vowels vowels and consonants consonants of the same script. The last
    letter of a personal name stays, and so does its gender's ending, as do
    country code, issuer digit, kind of key and top-level domain. Addresses keep valid octets, cards
    and account numbers get their check digits. From the attempt ATTEMPTS on, a name, address, phone number or key grows
    (a key or password without a letter or digit at once), and short forms of IPv6 become full ones.
    """
    seed = F.concat_ws("\x1f", F.lit(key), kind, name, attempt.cast("string"))
    stream = F.concat(*[F.sha2(F.concat(F.lit(f"{i}:"), seed), 512) for i in range(4)])
    return _let(stream, lambda x: _drawn(kind, name, attempt, seed, x))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _drawn(kind: Column, name: Column, attempt: Column, seed: Column, stream: Column) -> Column:
    """The surrogate of a canonical entity from its stream of hexadecimal digits."""
    byte = lambda i: F.conv(F.substring(stream, F.pmod(3 * i, F.lit(500)).cast("int") + 1, F.lit(4)), 16, 10).cast("bigint")
    size, prefix = F.length(name), _kept_prefix(kind, name)
    suffix = F.when(kind == "email", F.length(F.regexp_extract(name, r"(\.[^.]*)$", 1))).when(kind.isin(*PERSONS, "password"), F.lit(1)).when(kind == "pem", F.length(F.regexp_extract(name, r"(-----END [A-Z ]*-----)$", 1))).otherwise(F.lit(0))

    def drawn(c: Column, n: Column) -> Column:
        new = F.when(kind.isin("secret", "mac", "ipv6") & c.rlike("[0-9a-f]"), _pick(KINDS["hex"], n)).when(kind.isin(*EXACT) & c.rlike("[A-Z]"), _pick(KINDS["upper"], n))
        for k, members in _MEMBERS.items():
            new = new.when(F.instr(F.lit(members), c) > 0, _pick(KINDS[k], n))
        other = F.lit(None).cast("string")
        for script, letters in reversed(SCRIPTS.items()):
            other = F.when(c.rlike(rf"\p{{Is{script}}}"), _pick(letters, n)).otherwise(other)
        return new.when(c.rlike(r"\p{L}"), F.coalesce(other, _pick(SCRIPTS["Latin"], n))).otherwise(c)

    def swap(i: Column) -> Column:
        c = F.substring(name, i, F.lit(1))
        return F.when((i <= prefix) | (i > size - suffix), c).otherwise(drawn(c, byte(i)))

    chars = F.array_join(F.transform(F.sequence(F.lit(1), size), swap), "")
    chars = F.when((kind == "token") & name.startswith("eyJ"), F.regexp_replace(chars, r"^([^.]*)\.[^.]{3}", "$1.eyJ")).otherwise(chars)  # both parts are objects
    def finish(chars: Column) -> Column:
        octet = lambda i: (F.pmod(byte(F.lit(i)), F.lit(254)) + 1).cast("string")
        ip = F.concat_ws(".", *[octet(i) for i in (1, 5, 9, 13)])
        body = F.substring(chars, F.lit(1), size - 1)
        place = F.sequence(F.lit(1), size - 1)

        def luhn(acc: Column, i: Column) -> Column:
            d = F.substring(body, size - i, F.lit(1)).cast("int") * (F.lit(1) + F.pmod(i, F.lit(2)))
            return acc + F.when(d > 9, d - 9).otherwise(d)

        check = F.pmod(F.lit(10) - F.pmod(F.aggregate(place, F.lit(0), luhn), F.lit(10)), F.lit(10)).cast("string")
        at, more = _growth(kind, name), _beyond(kind, name, attempt)
        # a draw of its own for each character: the stream repeats after 500
        def added(i: Column) -> Column:
            n = F.conv(F.substring(F.sha2(F.concat(F.lit("+"), i.cast("string"), F.lit(":"), seed), 256), 1, 4), 16, 10).cast("bigint")
            return F.when(kind.isin("token", "pem"), _pick(KINDS["upper"], n)).otherwise(drawn(F.substring(name, at.cast("int"), F.lit(1)), n))

        extra = F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), added)
        groups = F.concat_ws(":", *[F.substring(stream, 4 * i + 1, 4) for i in range(8)])
        longer = F.concat(F.substring(chars, F.lit(1), at.cast("int")), F.array_join(extra, ""), F.substring(chars, (at + 1).cast("int"), size))

        # the check digits of an IBAN: the rest, the country and two zeros make a number that is 98 less them modulo 97
        turned = F.concat(F.substring(chars, F.lit(5), size), F.substring(chars, F.lit(1), F.lit(2)), F.lit("00"))

        def mod97(acc: Column, i: Column) -> Column:
            c = F.substring(turned, i, F.lit(1))
            return F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 87, F.lit(97)))

        rest = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), mod97)
        iban = F.concat(F.substring(chars, F.lit(1), F.lit(2)), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), F.substring(chars, F.lit(5), size))
        return F.when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "card", F.concat(body, check)).when((kind == "ipv6") & (more > 0), groups).when((more > 0) & at.isNotNull(), longer).otherwise(chars)

    return _let(chars, finish)


def _dressed(kind: Column, entity: Column, real: Column, name: Column) -> Column:
    """A canonical surrogate of ``real`` in the spelling of the string it replaces: its separators and capitals."""
    at, more, full = _growth(kind, real), F.length(name) - F.length(real), name
    grown = at.isNotNull() & (more > 0)
    extra = F.substring(name, (at + 1).cast("int"), more)
    name = F.when(grown, F.concat(F.substring(name, F.lit(1), at.cast("int")), F.substring(name, (at + more + 1).cast("int"), F.length(name)))).otherwise(name)
    strip, title = kind.isin("phone", "card", "ssn", "iban"), F.when(kind.isin(*PERSONS), _title(entity)).otherwise(F.lit(0))
    head, entity = F.substring(entity, F.lit(1), title), F.substring(entity, title + 1, F.length(entity))

    def one(i: Column) -> Column:
        c = F.substring(entity, i, F.lit(1))
        k = F.when(strip, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), SEPARATORS, ""))).otherwise(i)
        n = F.substring(name, k.cast("int"), F.lit(1))
        return F.when(strip & c.rlike(SEPARATORS), c).when(c.rlike(r"\p{Lu}"), F.upper(n)).otherwise(n)

    spelled = F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), one), "")
    put = _growth(kind, entity)
    longer = F.concat(F.substring(spelled, F.lit(1), put.cast("int")), extra, F.substring(spelled, (put + 1).cast("int"), F.length(entity)))
    spelled = F.when(grown, longer).otherwise(spelled)
    shout = (entity == F.upper(entity)) & (entity != F.lower(entity))
    other = (kind == "ipv6") & (F.length(full) != F.length(real))
    return F.when(kind.isin("ip", *EXACT) | other, full).when(shout, F.concat(head, F.upper(spelled))).otherwise(F.concat(head, spelled))


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """Rows ``(kind, name, surrogate)`` for the distinct entities, free of collisions.

    Two entities never share a surrogate, and no surrogate is an entity of the corpus:
    whoever collides is drawn anew with the next attempt, all but the smallest of those
    that share one, until nobody does; from ATTEMPTS on the draws get longer. So entities stay
    as distinct as they were, over all documents. A type that has run out of surrogates after MOST_ATTEMPTS is an error.
    """
    spread = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def drawn(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(spread, "kind", "name")  # few bytes, much work
        return rows.withColumn("surrogate", surrogate(F.col("kind"), F.col("name"), F.col("attempt"), key))

    rows = materialize(drawn(entities.select("kind", "name").distinct().withColumn("attempt", F.lit(0))), "pii-drawn")
    for _ in range(MOST_ATTEMPTS):
        shared = rows.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("name").alias("first")).where("n > 1")
        taken = rows.select("kind", F.col("name").alias("surrogate"), F.lit(True).alias("real"))
        checked = rows.join(shared, ["kind", "surrogate"], "left").join(taken, ["kind", "surrogate"], "left")
        again = F.coalesce(F.col("real"), F.lit(False)) | F.coalesce(F.col("name") != F.col("first"), F.lit(False))
        checked = materialize(checked.select("kind", "name", "attempt", "surrogate", again.alias("again")), "pii-checked")
        bad = checked.where("again")
        if not bad.limit(1).count():
            discard(rows)
            return checked.select("kind", "name", "surrogate")
        more = drawn(bad.select("kind", "name", (F.col("attempt") + 1).alias("attempt")))
        old, rows = rows, materialize(checked.where("not again").select(*more.columns).unionByName(more), "pii-drawn")
        discard(old, checked)
    raise ValueError(f"no free surrogates after {MOST_ATTEMPTS} attempts, for example of the type {rows.groupBy('kind').agg(F.max('attempt').alias('a')).orderBy(F.desc('a')).first()['kind']}")


#: Cheap conditions of which every text with an entity fulfils one: a pattern, or a literal that is in it.
HINT = r"[0-9@]|[A-Fa-f]{8}|[A-Fa-f]{2}[:-][A-Fa-f]{2}[:-]"
LITERALS = ("://", "::", "-----BEGIN", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "eyJ", "Mr", "MR", "Ms", "MS", "Miss", "MISS", "Mme", "MME", "Madame", "MADAME", "Monsieur", "MONSIEUR", "Frau", "FRAU", "Herr", "HERR", "Señor", "SEÑOR", "Sr", "SR", "Sir", "SIR", "Г-", "Dr", "DR", "Prof", "PROF")


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its entities replaced: ``(doc_id, text, n_entities, kinds)``.

    An entity gets the same surrogate wherever it occurs, in any spelling and under any title of
    its gender; different entities get different ones. ``key`` is a secret of whoever runs it:
    with it, and not without, surrogates can be drawn again. Texts without an entity come back
    unchanged, null ones null. Rows that repeat an identifier are each treated by their own
    text; null identifiers take part; other columns are not read; an empty table stays empty.
    Persons are found after a title only.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tag"))
    may = F.col("text").rlike(HINT)
    for literal in LITERALS:
        may = may | F.contains("text", F.lit(literal))
    may = F.coalesce(may, F.lit(False))
    found = rows.where(may).select("doc_id", "tag", F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), 0)).alias("pos", "entity"))
    # as a plain expression the kind, a cascade of tests, would be computed for each use
    found = materialize(found.withColumn("kind", kind_of(F.col("entity"))).distinct(), "pii-entities")
    found = materialize(found.withColumn("name", canonical(F.col("kind"), F.col("entity"))), "pii-found")
    names = surrogate_table(found, key)
    spelled = found.select("kind", "name", "entity").distinct().join(names, ["kind", "name"])
    spelled = materialize(spelled.select("kind", "entity", _dressed(F.col("kind"), F.col("entity"), F.col("name"), F.col("surrogate")).alias("new")), "pii-spelled")
    per = found.join(spelled, ["kind", "entity"]).groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(F.struct("pos", "new", "kind"))).alias("r"))  # as long as a text at most
    per = materialize(per.select(F.col("doc_id").alias("d"), F.col("tag").alias("g"), "r"), "pii-replacements")
    joined = rows.where(may).join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("g")), "left")
    news = F.concat(F.transform("r", lambda x: x["new"]), F.array(F.lit("")))
    text = F.array_join(F.zip_with(F.split("text", PATTERN, -1), news, lambda a, b: F.concat(a, b)), "")
    none = F.array().cast("array<string>")
    kinds = F.when(F.col("r").isNull(), none).otherwise(F.array_sort(F.array_distinct(F.transform("r", lambda x: x["kind"]))))
    out = joined.select("doc_id", F.when(F.col("r").isNull(), F.col("text")).otherwise(text).alias("text"), F.when(F.col("r").isNull(), 0).otherwise(F.size("r")).cast("bigint").alias("n_entities"), kinds.alias("kinds"))
    return out.unionByName(rows.where(~may).select("doc_id", "text", F.lit(0).cast("bigint").alias("n_entities"), none.alias("kinds")))
