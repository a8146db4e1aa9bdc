"""Operator 3: keyed surrogates for personal data (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hot_join, stored, temporary

SECRET_LEAD = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
MALE, FEMALE = "Mr|Herr|Monsieur|Señor|Sr|Don|Господин|Κύριος", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Doña|Госпожа|Κυρία"
_NAME = r"\p{Lu}[\p{L}'’-]+"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<!\d)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\d)",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?\d{1,3}|[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?\d{3})(?![A-Z0-9])",
    "key": r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
    "secret": SECRET_LEAD + r"[A-Za-z0-9+/_.=~-]{6,}",
    "hex": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
#: \1 of the card pattern stands for the only group that captures.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Attempts after which a surrogate that keeps its format gets longer, by a digit an attempt.
KEEPS_FORMAT = 6


def kind_of(m: Column) -> Column:
    """The kind of a mention, the first whose pattern it is."""
    out = None
    for kind, p in PATTERNS.items():
        test = m.rlike(rf"\A(?:{p})\z")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("secret")


#: Country calling codes of one and two digits; all others have three.
_CALLING = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def lead_of(kind: Column, m: Column) -> Column:
    """What stays of a mention: the honorific, the name of a secret, a calling code, a country or key prefix."""
    lead = F.when(kind == "secret", F.regexp_extract(m, rf"\A{SECRET_LEAD}", 0))
    lead = lead.when(kind == "name", F.regexp_extract(m, r"\A[^ ]+ ", 0)).when(kind == "phone", F.regexp_extract(m, rf"\A{_CALLING}", 0))
    return lead.when(kind == "key", F.substring(m, 1, 4)).when(kind == "iban", F.substring(m, 1, 2)).otherwise("")


def norm_of(kind: Column, m: Column) -> Column:
    """What two mentions of one entity share: case for addresses and names, and separators, do not count."""
    plain = F.when(kind.isin("phone", "ssn", "card", "iban"), F.regexp_replace(m, r"[ ().-]", ""))
    return plain.when(kind.isin("email", *NAMES), F.lower(m)).otherwise(m)


def _number(digest: Column, k: Column) -> Column:
    """16 bits of the digest for the k-th character; digests of 512 bits are read around."""
    return F.conv(F.substr(digest, (k % 31) * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(k / 31).cast("int") * 7


def _character(hexadecimal: Column, c: Column, v: Column) -> Column:
    span = F.when(hexadecimal, 6).otherwise(26)
    return F.when(c.rlike("[0-9]"), (v % 10).cast("string")).when(c.rlike("[a-z]"), F.char(v % span + 97)).when(c.rlike("[A-Z]"), F.char(v % span + 65)).otherwise(c)


#: Kinds of the words of a name: given names by gender, and surnames, which all bearers share.
NAMES = ("given-m", "given-f", "surname")
#: Syllables of a script, and the endings of the three kinds.
_SYLLABLES = {
    "latin": (["ba", "de", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va", "ze", "fi", "go", "ha", "ju"], "n", "a", "s"),
    "cyrillic": (["ба", "де", "ки", "ло", "му", "на", "пе", "ри", "со", "ту", "ва", "зе", "фи", "го", "ха", "жу"], "н", "а", "к"),
    "greek": (["βα", "δε", "κι", "λο", "μυ", "να", "πε", "ρι", "σο", "τυ", "θα", "ζε", "φι", "γο", "χα", "ξυ"], "ν", "α", "ς"),
}


def _syllable(table: Column):
    return lambda c: F.element_at(table, F.conv(c, 16, 10).cast("int") + 1)


def _name_word(word: Column, digest: Column, kind: Column, attempt: Column) -> Column:
    """A word of four syllables, one more an attempt, in the word's script, ended by its kind, in the word's case."""
    # the digest's own digits choose the syllables
    letters = F.filter(F.split(F.substr(digest, F.lit(1), F.least(attempt, F.lit(60)) + 4), ""), lambda c: c != "")
    out = None
    for script, test in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", "")):
        syllables, male, female, both = _SYLLABLES[script]
        spelt = F.array_join(F.transform(letters, _syllable(F.array(*[F.lit(s) for s in syllables]))), "")
        made = F.concat(spelt, F.when(kind == "given-f", female).when(kind == "given-m", male).otherwise(both))
        out = F.when(word.rlike(test), made) if out is None else out.when(word.rlike(test), made) if test else out.otherwise(made)
    return F.when(word == F.upper(word), F.upper(out)).when(word == F.lower(word), out).otherwise(F.initcap(out))


def _digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c.rlike("[0-9]")), lambda c: c.cast("int"))


def _card(spelt: Column, body: Column) -> Column:
    """A card number with the issuer's digit kept and the check digit right."""
    digits = _digits(F.concat(F.substr(body, F.lit(1), F.lit(1)), F.substr(spelt, F.lit(2))))
    # every second digit, from the one before the check digit, counts double
    worth = F.transform(digits, lambda d, i: F.when(i == F.size(digits) - 1, 0).when((F.size(digits) - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    check = (F.lit(10) - F.aggregate(worth, F.lit(0), lambda a, d: a + d) % 10) % 10
    return F.concat(F.substr(body, F.lit(1), F.lit(1)), F.substr(spelt, F.lit(2), F.length(spelt) - 2), check.cast("string"))


def _iban(spelt: Column, country: Column) -> Column:
    """The account part of a number behind check digits that fit it and the country."""
    rest = F.substr(spelt, F.lit(3))
    chars = F.filter(F.split(F.concat(rest, country, F.lit("00")), ""), lambda c: c.rlike("[A-Z0-9]"))
    remainder = F.aggregate(chars, F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))
    return F.concat(F.lpad((F.lit(98) - remainder).cast("string"), 2, "0"), rest)


def surrogate(kind: Column, body: Column, norm: Column, attempt: Column, key: str, lead: Column | None = None) -> Column:
    """The replacement of a mention's body, or of one word of a name, from a keyed digest of its entity.

    Letters become letters of the same case, digits digits, marks and the top-level domain stay; octets stay
    octets; cards keep their issuer, cards and account numbers have right check digits; names keep script, number of
    words, case and gender. As the k-th letter or digit depends on the entity and k only, mentions in other formats get
    the same surrogate in their own format. With the attempts names get more syllables, the others more digits (in
    front of an address, after a colon for octets), so that there is a surrogate of its own for every entity
    however many there are.
    """
    entity = F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"))
    return _once(F.sha2(entity, 512), lambda digest: _spelt(kind, body, digest, attempt, lead))


def _spelt(kind: Column, body: Column, digest: Column, attempt: Column, lead: Column | None) -> Column:
    octets = F.array_join(F.transform(F.split(body, r"\."), lambda o, i: (F.conv(F.substr(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % 254 + 1).cast("string")), ".")
    # counted over letters and digits only, so that separators do not shift what follows them
    head = F.when(kind == "email", F.regexp_extract(body, r"\A(.*)\.[^.]*\z", 1)).otherwise(body)
    hexadecimal = kind.isin("hex", "secret") & body.rlike(r"\A([0-9a-f]+|[0-9A-F]+)\z")
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        counts = c.rlike("[A-Za-z0-9]")
        return F.struct(F.concat(acc["s"], F.when(counts, _character(hexadecimal, c, _number(digest, acc["k"]))).otherwise(c)).alias("s"), (acc["k"] + counts.cast("int")).alias("k"))

    spelt = F.aggregate(F.split(head, ""), start, step, lambda acc: acc["s"])
    checked = _once(spelt, lambda t: F.when(kind == "card", _card(t, body)).when(kind == "iban", _iban(t, F.lit("") if lead is None else lead)).otherwise(t))
    tail = F.when(kind == "email", F.regexp_extract(body, r"\.[^.]*\z", 0)).otherwise("")
    more = F.translate(F.substr(digest, F.lit(65), F.least(F.greatest(attempt - KEEPS_FORMAT, F.lit(0)), F.lit(64))), "abcdef", "123456")
    made = F.when(kind == "ip", F.concat(octets, F.when(more != "", F.concat(F.lit(":"), more)).otherwise("")))
    return made.when(kind.isin(*NAMES), _name_word(body, digest, kind, attempt)).when(kind == "email", F.concat(more, spelt, tail)).otherwise(F.concat(checked, more))


def _once(value: Column, of) -> Column:
    """``of`` the value, computed once however often ``of`` uses it."""
    return F.transform(F.array(value), of)[0]


def _mention(m: Column) -> Column:
    """(mention, kind, lead, body, entities) of a mention: one entity (kind, body, norm), or one for each word of a name."""
    one = lambda k, b: F.struct(k.alias("kind"), b.alias("body"), norm_of(k, b).alias("norm"))

    def named(words: Column) -> Column:
        given = F.when(m.rlike(rf"\A(?:{FEMALE})\b"), "given-f").otherwise("given-m")
        return F.transform(words, lambda w, i: _once(F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(given), lambda k: one(k, w)))

    def told(kind: Column, lead: Column, body: Column) -> Column:
        entities = F.when(kind == "name", _once(F.split(body, " "), named)).otherwise(F.array(one(kind, body)))
        return F.struct(m.alias("m"), kind.alias("kind"), lead.alias("lead"), body.alias("body"), entities.alias("entities"))

    return _once(kind_of(m), lambda kind: _once(lead_of(kind, m), lambda lead: _once(F.substr(m, F.length(lead) + 1), lambda body: told(kind, lead, body))))


def _entity(e: Column) -> Column:
    return F.concat_ws("|", e["kind"], e["norm"])


def assign(spark: SparkSession, entities: DataFrame, key: str) -> DataFrame:
    """Entities (kind, norm) whose first surrogate will not do: (kind, norm, attempt).

    A surrogate is refused if it is another entity of its kind or if an entity smaller in order has it; the
    entity then tries the next digest. Every round checks all entities, by groupings and equi-joins; as surrogates
    get longer with the attempts, the rounds end.
    """
    cur = entities.select("kind", "norm", F.lit(0).alias("attempt"))
    while True:
        s = surrogate(F.col("kind"), F.col("norm"), F.col("norm"), F.col("attempt"), key)
        cur = stored(spark, cur.select("kind", "norm", "attempt", F.lower(s).alias("s")), "surrogates")
        shared = cur.groupBy("kind", "s").agg(F.min("norm").alias("first"), F.count("*").alias("n")).where("n > 1")
        taken = cur.select(F.col("kind").alias("k2"), F.lower("norm").alias("real")).distinct()
        bad = cur.join(shared, ["kind", "s"]).where("norm != first").select("kind", "norm").union(cur.join(taken, (F.col("kind") == F.col("k2")) & (F.col("s") == F.col("real"))).select("kind", "norm")).distinct()
        bad = stored(spark, bad, "refused")
        if bad.isEmpty():
            return cur.where("attempt > 0").select("kind", "norm", "attempt")
        cur = cur.join(bad.withColumn("again", F.lit(1)), ["kind", "norm"], "left").select("kind", "norm", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))


def replace_entities(docs: DataFrame, key: str = "surrogate-key", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text with personal data replaced: (doc_id, text, n_entities, kinds).

    Finds addresses, numbers, keys, secrets and names after an honorific; a name of two words so found is replaced
    where it stands without one in the same text, too. Equal entities get equal surrogates in all rows, different
    entities different ones (checked over all entities of the input); of names each word is an entity, so a surname
    is the same alone and after a given name, and is replaced where it stands alone in the same text;
    another ``key`` gives other surrogates. Texts without entities, null and empty ones stay as they are,
    with no kinds. Repeated rows are replaced alike; rows without an id too. ``kinds`` is sorted and
    comma-joined. Extra columns are ignored.
    """
    with temporary():
        return _replaced(docs, key, id_col, text_col)


def _replaced(docs: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows that share this number share their attempts, which belong to entities: a number met twice does no harm
    src = src.withColumn("row", F.coalesce("doc_id", F.xxhash64("text")))
    src = src.withColumn("found", F.coalesce(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), F.array().cast("array<string>")))
    # each row's own distinct mentions first: a task never sends on the same mention twice for a row
    mentions = src.where("size(found) > 0").select("row", F.explode(F.array_distinct("found")).alias("m"))
    per_text = mentions.groupBy("m").agg(F.count("*").alias("rows"))
    entities = per_text.select(F.explode(_mention(F.col("m"))["entities"]).alias("e")).groupBy("e.kind", "e.norm").agg(F.count("*").alias("texts"))
    entities = stored(spark, entities, "entities")
    again = stored(spark, assign(spark, entities, key), "attempts")
    if again.isEmpty():
        out = src.withColumn("tries", F.create_map().cast("map<string,int>"))
    else:
        told = mentions.select("row", F.explode(_mention(F.col("m"))["entities"]).alias("e")).select("row", _entity(F.col("e")).alias("entity"))
        weights = told.groupBy("entity").agg(F.count("*").alias("n"))
        wanted = stored(spark, again.select(F.concat_ws("|", "kind", "norm").alias("entity"), "attempt").join(weights, "entity"), "wanted")
        tries = hot_join(spark, told, wanted, "entity", "n", "row").where("attempt is not null").groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias("tries"))
        out = src.join(stored(spark, tries, "tries", keep=True).withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left").drop("_row")
        out = out.withColumn("tries", F.coalesce("tries", F.create_map().cast("map<string,int>")))
    tried = lambda e: F.coalesce(F.try_element_at(F.col("tries"), _entity(e)), F.lit(0))
    replaced = lambda x: F.array_join(F.transform(x["entities"], lambda e: surrogate(e["kind"], e["body"], e["norm"], tried(e), key, x["lead"])), " ")
    made = F.transform(F.transform("found", lambda m: _mention(m)), lambda x: F.struct(x["kind"].alias("kind"), x["lead"].alias("lead"), x["body"].alias("body"), replaced(x).alias("s")))
    out = out.withColumn("made", F.when(F.size("found") > 0, made))
    pieces = F.zip_with(F.split("text", ANY, -1), F.transform("made", lambda x: F.concat(x["lead"], x["s"])), lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
    out = out.withColumn("new", F.when(F.col("made").isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text")))
    # whole names first, then surnames alone
    named, last = F.filter("made", lambda x: x["kind"] == "name"), lambda c: F.element_at(F.split(c, " "), -1)
    pairs = F.concat(F.transform(F.filter(named, lambda x: x["body"].contains(" ")), lambda x: F.struct(x["body"].alias("body"), x["s"].alias("s"))), F.transform(named, lambda x: F.struct(last(x["body"]).alias("body"), last(x["s"]).alias("s"))))
    bare = F.aggregate(F.array_distinct(pairs), F.col("new"), lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}'’-])"), x["body"], F.lit(r"(?![\p{L}'’-])")), x["s"]))
    text = F.when(F.exists("made", lambda x: x["kind"] == "name"), bare).otherwise(F.col("new"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("made", lambda x: x["kind"]))), ",")
    return out.select("doc_id", text.alias("text"), F.size("found").cast("long").alias("n_entities"), F.coalesce(kinds, F.lit("")).alias("kinds"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(documents(spark, sf_dir))
