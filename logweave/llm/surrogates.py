"""Personal data replaced by keyed, type-consistent surrogates (op 5, native).

One pattern finds e-mail addresses, IBANs, card numbers, social-security numbers, IPv4
addresses, phone numbers and names after honorifics.  Every different entity gets one surrogate,
derived from a secret key:

* Numbers keep length and leading digit and, if the original had them, a valid Luhn or IBAN
  check; private IPv4 ranges stay private; a mail domain lies below a reserved ``example`` domain.
* A phone number is known by its last nine digits, so a number with and without its country code
  or trunk zero is one entity; what stands before them stays.
* A name is known by its words: each word gets one stem in its script, whose ending says the
  honorific's gender, so a full name and its short form share their surrogate.  In a row that names a
  person, later capitalised mentions of these words without an honorific are replaced alike, and an
  honorific of no gender takes the row's.  (A word that is also a common noun goes with them.)
* Each occurrence is written in its own format (spaces, brackets, dashes, capitals).
* Surrogates are checked over the whole corpus: no two entities of a kind share one and none is
  an entity of the corpus.  Losers of a collision are drawn again until none is left, so
  equal entities stay equal and different ones stay different.  Where a corpus holds so much of a
  space that draws stay without success, its entities of that shape swap places in a ring of
  keyed order, so that none keeps its own.

Only built-in functions run.  Texts without an entity pass by; of the others, occurrences
travel without their text, which is split once and joined again by row.

Defined results: null text stays null; repeated rows and null doc_ids each keep a row; an empty
table gives an empty result; extra columns pass through unchanged; a piece of text that
several patterns could take goes to the leftmost match, then to the order above; ``n_entities``
counts what the pattern finds, not the later mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .shared import materialise

#: Honorifics by gender.
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "г-жа")
NEUTRAL = ("Dr", "Doctor", "Prof", "Professor")
#: Syllables and gendered endings by script.
SYLLABLES = {"latin": "bel dor fen gal hur kel lom mar nor pel quin ras sel tor ul ven wil yor zan ber cal dun fal gor".split(),
             "cyrillic": "бел дор фен гал хур кел лом мар нор пел рас сел тор вен зан бер кал дун фал гор".split(),
             "greek": "βελ δορ φεν γαλ κελ λομ μαρ νορ πελ ρασ σελ τορ ζαν βερ καλ δουν φαλ γορ".split()}
#: Male, female, neither.
ENDINGS = {"latin": ("o", "a", "e"), "cyrillic": ("ов", "ова", "о"), "greek": ("ος", "α", "ο")}
ROUNDS = 60
#: Digits that make a phone number one entity; country codes and trunk zeros stand before them.
PHONE_DIGITS = 9

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_HONORIFIC = _any_of(MALE + FEMALE + NEUTRAL)
#: An apostrophe belongs to a name's word if a letter follows, but for the genitive's.
_NAME = r"\p{Lu}(?:[\p{L}\p{M}]|['’](?=\p{L})(?![sS](?!\w)))++"
_LEAD = rf"(?U)^(?:(?:{_HONORIFIC})\.? )+"
PATTERNS = (
    r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,63})@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}",
    r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)",
    r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    r"(?<!\w)\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w)",
    r"(?<!\w)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\w)",
    r"(?<![\w.\-])\d{3}([.\-])\d{3}\1\d{4}(?![\w\-])",
    r"(?<![\w.\-])(?<!\d )\d{3} \d{3} \d{4}(?![\w\-]| \d)",
    r"(?<![\w.\-])(?<!\d )0[1-9]\d{1,3}[ /\-](?:\d{5,9}|\d{3,4}(?:[ \-]\d{2,4}){1,2})(?![\w\-])",
    rf"(?<!\w)(?:{_HONORIFIC})\.?(?: (?:{_HONORIFIC})\.?)* {_NAME}(?:[ -]{_NAME}){{0,2}}",
)
PATTERN = "(?U)" + "|".join(PATTERNS).replace(r"([.\-])\d{3}\1", r"(?:\.\d{3}\.|-\d{3}-)")
#: Also a capitalised word that could mention a name; no part of a mail address.
WIDE = rf"{PATTERN}|(?<!\w){_NAME}(?!\w|[\w.%+\-]*@)"
#: Every entity has a digit, an at sign or an honorific.
GATE = rf"(?U)[\d@]|(?:{_HONORIFIC})\.? \p{{Lu}}"


def _chars(value: Column) -> Column:
    return F.when(F.length(value) > 0, F.transform(
        F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def kind_of(found: Column) -> Column:
    return (F.when(found.contains("@"), "email")
            .when(found.rlike(r"^[A-Z]{2}\d{2}"), "iban")
            .when(found.rlike(r"^\d+(\.\d+){3}$"), "ip")
            .when(found.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
            .when(found.rlike(r"^[^\d+(]"), "name")
            .when(found.rlike(r"^[+(]") | (F.length(_digits(found)) < 13), "phone")
            .otherwise("card"))


def canonical(kind: Column, found: Column) -> Column:
    """What makes two occurrences one entity."""
    return (F.when(kind.isin("email", "name"), F.lower(found))
            .when(kind == "iban", F.regexp_replace(found, " ", ""))
            .when(kind == "ip", found)
            .when(kind == "phone", F.regexp_extract(_digits(found), rf"([0-9]{{1,{PHONE_DIGITS}}})$", 1))
            .otherwise(_digits(found)))


def gender(lead: Column) -> Column:
    """Of the honorifics before a name: m, f or n (neither)."""
    return (F.when(lead.rlike(rf"(?U)(?<!\w)(?:{_any_of(FEMALE)})(?!\w)"), "f")
            .when(lead.rlike(rf"(?U)(?<!\w)(?:{_any_of(MALE)})(?!\w)"), "m").otherwise("n"))


def parts(found: Column) -> Column:
    """A match as units to replace: (lead, found, kind, sex, first), with ``lead`` the text kept before each."""
    def unit(lead: Column, value: Column, kind: Column, sex: Column, first: Column) -> Column:
        return F.struct(lead.alias("lead"), value.alias("found"), kind.alias("kind"), sex.alias("sex"), first.alias("first"))

    lead, kind, none = F.regexp_extract(found, _LEAD, 0), kind_of(found), F.lit(None).cast("string")
    name = F.regexp_replace(found, _LEAD, "")
    gaps = F.regexp_extract_all(name, F.lit("[ -]"), F.lit(0))
    words = F.transform(F.regexp_extract_all(name, F.lit("[^ -]+"), F.lit(0)), lambda w, n: unit(
        F.when(n == 0, lead).otherwise(F.coalesce(F.get(gaps, n - 1), F.lit(""))), w, F.lit("name"), gender(lead), n == 0))
    other = F.when((kind == "name") & (lead == ""), "mention").otherwise(kind)
    return F.when((kind == "name") & (lead != ""), words).otherwise(F.array(unit(F.lit(""), found, other, none, F.lit(True))))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo ten."""
    size = F.length(digits)
    doubled = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(
        (size - i) % 2 == 1, 2 * F.substring(digits, i, F.lit(1)).cast("int")
        - F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0))
        .otherwise(F.substring(digits, i, F.lit(1)).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def _iban_rest(account: Column) -> Column:
    """Remainder by 97 of an account that was turned round, letters counted from 10."""
    return F.aggregate(_chars(account), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def surrogate(kind: str, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate's canonical form for one kind of entity."""
    draw = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), canon, attempt.cast("string")), 512)

    def number(i: Column, below: int) -> Column:
        """The i-th keyed number below ``below``."""
        return F.conv(F.substring(draw, (i % 60) * 2 + 1, F.lit(4)), 16, 10).cast("int") % below

    def alike(value: Column) -> Column:
        """``value`` with every letter and digit replaced by a keyed one of its class."""
        letters = lambda first, below, i: F.char(F.lit(ord(first)) + number(i, below))
        return F.array_join(F.transform(_chars(value), lambda c, i: F.when(c.rlike("[0-9]"), letters("0", 10, i))
                                        .when(c.rlike("[a-z]"), letters("a", 26, i)).when(c.rlike("[A-Z]"), letters("A", 26, i))
                                        .otherwise(c)), "")

    # The leading digit is kept as long as there is room left below it.
    first = F.when(attempt < 12, F.substring(canon, 1, 1)).otherwise((number(F.lit(57), 9) + 1).cast("string"))
    if kind in ("ssn", "phone"):
        return F.concat(first, alike(F.substring(canon, F.lit(2), F.length(canon))))
    if kind == "card":
        body = F.concat(first, alike(F.substring(canon, F.lit(2), F.length(canon) - 2)))
        check = ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
        return F.when(_luhn(canon) == 0, F.concat(body, check)).otherwise(F.concat(body, number(F.lit(59), 10).cast("string")))
    if kind == "ip":
        octets = [number(F.lit(n), 256).cast("string") for n in (3, 6)]
        last = (number(F.lit(9), 254) + 1).cast("string")
        middle = (number(F.lit(12), 16) + 16).cast("string")
        anywhere = F.concat_ws(".", (number(F.lit(0), 223) + 1).cast("string"), *octets, last)
        # Public addresses get a first byte that no private range has; the class is kept as long as there is room.
        return (F.when(attempt >= 12, anywhere)
                .when(canon.rlike(r"^(10|127)\."), F.concat_ws(".", F.substring_index(canon, ".", 1), *octets, last))
                .when(canon.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), octets[0], last))
                .when(canon.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\."), F.concat_ws(".", F.lit("172"), middle, octets[0], last))
                .otherwise(F.concat_ws(".", (number(F.lit(0), 99) + 11).cast("string"), *octets, last)))
    if kind == "iban":
        country, account = F.substring(canon, 1, 2), alike(F.substring(canon, F.lit(5), F.length(canon)))
        check = F.lpad((98 - _iban_rest(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, check, account)
    if kind == "email":
        local, domain = F.substring_index(canon, "@", 1), F.regexp_extract(canon, "@([^.]*)", 1)
        more = F.when(attempt > 2, F.substring(draw, F.lit(100), F.least(attempt, F.lit(12)))).otherwise("")
        ending = F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), number(F.lit(58), 3) + 1)
        return F.concat(alike(local), more, F.lit("@"), F.reverse(alike(F.reverse(domain))), F.lit(".example."), ending)
    if kind == "name":
        def stem(name: str) -> Column:
            """Syllables of a script; later draws are longer."""
            listed, size = F.array(*map(F.lit, SYLLABLES[name])), len(SYLLABLES[name])
            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1) + F.least(attempt, F.lit(12))),
                                            lambda i: F.element_at(listed, number(i * 2, size) + 1)), "")

        return F.when(canon.rlike(CYRILLIC), stem("cyrillic")).when(canon.rlike(GREEK), stem("greek")).otherwise(stem("latin"))
    raise ValueError(kind)


CYRILLIC, GREEK = "[а-яё]", "[α-ωά-ώ]"
KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "name")


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    made = F.when(F.lit(False), F.lit(""))
    for kind in KINDS:
        made = made.when(F.col("kind") == kind, surrogate(kind, F.col("canon"), F.col("attempt"), key))
    return entities.withColumn("made", made)


def _taken(entities: DataFrame) -> DataFrame:
    """(kind, made) that no surrogate may be: the entities, of names' words also what an ending would make them."""
    endings = _any_of(tuple(e for script in ENDINGS.values() for e in script))
    stems = F.regexp_replace("canon", f"(?:{endings})$", "")
    both = F.when(F.col("kind") == "name", F.array_distinct(F.array("canon", stems))).otherwise(F.array("canon"))
    return entities.select("kind", F.explode(both).alias("made")).distinct()


def _shape() -> Column:
    kind, canon = F.col("kind"), F.col("canon")
    more = F.when(kind == "iban", F.substring(canon, 1, 2)).when(kind == "card", (_luhn(canon) == 0).cast("string")).otherwise("")
    return F.concat_ws("|", kind, F.when(kind.isin("email", "name", "ip"), 0).otherwise(F.length(canon)), more)


def _ring(entities: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """(kind, canon, made): the entities of ``shapes``, each in the place of the next one of its shape."""
    turn = F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon"), 256)
    placed = number_rows(entities.withColumn("shape", _shape()).join(shapes, "shape", "left_semi").withColumn("turn", turn),
                         ["turn", "canon"], ["shape"], "place")
    sizes = placed.groupBy("shape").agg(F.max("place").alias("size"))
    after = placed.select("shape", F.col("place").alias("next"), F.col("canon").alias("made"))
    return (placed.join(sizes, "shape").withColumn("next", F.col("place") % F.col("size") + 1)
            .join(after, ["shape", "next"]).select("kind", "canon", "made"))


def assign(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, made): a surrogate of its own for every row of ``entities(kind, canon)``.

    Each round draws for the entities still without one; of those that drew the same the
    smallest stays, unless the draw is taken or is itself an entity, and the rest draws again.
    Shapes in which some are left after ``rounds`` rounds are full: their entities swap places.
    """
    entities = entities.select("kind", "canon")
    parts_ = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pending, accepted, taken = entities.withColumn("attempt", F.lit(0)), None, _taken(entities)
    for _ in range(rounds):
        # Dealt by count: few bytes, but dear to draw for, so adaptive merging would leave it to one task.
        drawn = materialise(_drawn(pending.repartition(parts_), key), "drawn")
        first = drawn.groupBy("kind", "made").agg(F.min("canon").alias("canon"))
        free = first.join(taken, ["kind", "made"], "left_anti")
        if accepted is not None:
            free = free.join(accepted.select("kind", "made"), ["kind", "made"], "left_anti")
        fresh = materialise(free.select("kind", "canon", "made"), "accepted")
        accepted = fresh if accepted is None else accepted.unionByName(fresh)
        pending = drawn.join(fresh, ["kind", "canon"], "left_anti").select(
            "kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return accepted
    full = materialise(pending.select(_shape().alias("shape")).distinct(), "full")
    roomy = accepted.withColumn("shape", _shape()).join(full, "shape", "left_anti").select("kind", "canon", "made")
    return roomy.unionByName(_ring(entities, full, key))


def render(kind: Column, found: Column, made: Column, sex: Column) -> Column:
    """The surrogate in the format of one occurrence."""
    def fill(keep: str) -> Column:
        """``found`` with its last characters outside ``keep`` replaced by those of ``made`` in turn."""
        before = F.length(F.regexp_replace(found, keep, "")) - F.length(made)

        def shown(c: Column, i: Column) -> Column:
            at = F.length(F.regexp_replace(F.substring(found, F.lit(1), i + 1), keep, "")) - before
            return F.when(c.rlike(keep) | (at < 1), c).otherwise(F.substring(made, at, F.lit(1)))

        return F.array_join(F.transform(_chars(found), shown), "")

    def ended(script: str) -> Column:
        male, female, neither = ENDINGS[script]
        return F.concat(made, F.when(sex == "f", female).when(sex == "m", male).otherwise(neither))

    capitals = F.upper(found) == found
    name = F.initcap(F.when(made.rlike(CYRILLIC), ended("cyrillic")).when(made.rlike(GREEK), ended("greek")).otherwise(ended("latin")))
    return (F.when(kind == "email", F.when(capitals, F.upper(made)).otherwise(made))
            .when(kind == "ip", made)
            .when(kind == "iban", fill(" "))
            .when(kind == "name", F.when(capitals & (F.length(found) > 1), F.upper(name)).otherwise(name))
            .otherwise(fill("[^0-9]")))


def _occurrences(cut: DataFrame) -> DataFrame:
    """(key, at, found, kind, canon, sex) of every unit of ``cut``; null kinds are words that mention nobody."""
    units = cut.select("__key", F.posexplode("__units").alias("at", "unit")).select("__key", "at", "unit.*")
    word = F.lower("found")
    people = (units.where("kind = 'name'").groupBy("__key", word.alias("word")).agg(F.min("sex").alias("known")))
    worded = units.where("kind in ('name', 'mention')").withColumn("word", word).join(people, ["__key", "word"], "left")
    # f comes before m and n, and m before n: whoever has a gender once in a row has it all through the row.
    sex = F.when(F.col("sex").isin("f", "m"), F.col("sex")).otherwise(F.col("known"))
    worded = worded.withColumn("sex", sex).withColumn("kind", F.when(F.col("known").isNotNull(), "name"))
    every = units.where("kind not in ('name', 'mention')").unionByName(worded.select(units.columns))
    return every.select("__key", "at", "found", "kind", canonical(F.col("kind"), F.col("found")).alias("canon"), "sex")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities`` long (null for null text)."""
    names = docs.columns
    gate = F.coalesce(F.col("text").rlike(GATE), F.lit(False))
    row = F.struct(*[F.col(f"`{n}`") for n in names if n != "text"], F.lit(True).alias("__row"))
    kept = docs.select(row.alias("__rest"), "text", F.when(gate, F.regexp_extract_all("text", F.lit(PATTERN), 0)).alias("__found"))
    hit = F.coalesce(F.size("__found") > 0, F.lit(False))
    named = F.exists("__found", lambda f: f.rlike(_LEAD))
    found = F.when(named, F.regexp_extract_all("text", F.lit(WIDE), 0)).otherwise(F.col("__found"))
    pieces = F.when(named, F.split("text", WIDE, -1)).otherwise(F.split("text", PATTERN, -1))
    # The text between matches, cut at every unit as well.
    between = F.flatten(F.zip_with("__pieces", "__parts", lambda piece, units: F.when(units.isNull(), F.array(piece)).otherwise(
        F.transform(units, lambda u, n: F.when(n == 0, F.concat(piece, u["lead"])).otherwise(u["lead"])))))
    parted = kept.where(hit).select(
        "__rest", F.size("__found").cast("long").alias("__count"), pieces.alias("__pieces"),
        F.transform(found, parts).alias("__parts"))
    cut = materialise(parted.select(
        "__rest", "__count", between.alias("__pieces"), F.flatten("__parts").alias("__units"),
        F.monotonically_increasing_id().alias("__key")), "entities")

    seen = materialise(_occurrences(cut), "occurrences")
    known = seen.where("kind is not null")
    mapping = assign(known.select("kind", "canon").distinct(), key)
    shown = known.join(mapping, ["kind", "canon"]).select(
        "__key", "at", render(F.col("kind"), F.col("found"), F.col("made"), F.col("sex")).alias("shown"))
    shown = shown.unionByName(seen.where("kind is null").select("__key", "at", F.col("found").alias("shown")))
    # All occurrences of one text, no larger than the text.
    lists = shown.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("at", "shown"))).alias("__shown"))
    woven = F.flatten(F.zip_with("__pieces", "__shown", lambda piece, s: F.array(piece, F.coalesce(s["shown"], F.lit("")))))
    changed = cut.select("__rest", "__count", "__pieces", "__key").join(lists, "__key").select(
        "__rest", F.array_join(woven, "").alias("text"), "__count")
    same = kept.where(~hit).select("__rest", "text", F.when(F.col("text").isNotNull(), F.lit(0)).cast("long").alias("__count"))
    both = changed.unionByName(same)
    return both.select(*[F.col("text") if n == "text" else F.col("__rest")[n].alias(n) for n in names],
                       F.col("__count").alias("n_entities"))


def query_rows(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_entities) of every row."""
    return replace(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
