import re

import pytest
from pyspark.sql import functions as F

from logweave.llm import surrogates

SCHEMA = "doc_id long, text string, kind string, n_entities string"
KEY = "test key"
TEXTS = [
    None, "", "nothing to see, 12 of 2024, v1.2.3, 10 000 000 and 3.14",
    "Write to Anna.Smith+x@mail5.example.com or anna.smith+x@MAIL5.example.com, please.",
    "Call +1 (915) 555-2271 or +1-915-555-2271; also (212) 555-0101.",
    "Card 4545 4004 3945 0384 and 4545400439450384, not Luhn 4545400439450385.",
    "Host 10.1.2.3, 192.168.0.17. Not 1.2.3 nor 999.1.1.1 nor 1.2.3.4.5",
    "SSN 123-45-6789 but not 9123-45-67890 or A555-123-4567.",
    "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000",
    "Mrs Anna Schmidt met Mr John Smith and Frau ANNA SCHMIDT; Mr Иван Петров too. Mrs Anna Schmidt left.",
    "Mr John Smith came. Later Mr Smith left. John Smith paid; SMITH's car, Smithson stayed. Dr. Anna Weber and Prof Klein met "
    "Frau Weber. Weber left. Write to Weber.x@mail.example.com.",
    "Call +1 (915) 555-2271, (915) 555-2271 or 915 555 2271; 0171 2345678 is +49 171 2345678.",
    "two@b.example.org" * 1 + " " + "word " * 30000 + "+44 20 7946 0958",
]


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(text):
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


@pytest.fixture(scope="module")
def out(spark):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4]), (None, TEXTS[4])]
    docs = spark.createDataFrame([(i, t, "k", "n") for i, t in rows], SCHEMA).repartition(3)
    docs = docs.select("doc_id", "text", "kind")
    made = surrogates.replace(docs, KEY)
    assert made.columns == ["doc_id", "text", "kind", "n_entities"]
    return made.collect()


def text(out, n):
    return next(r.text for r in out if r.doc_id == n)


def test_untouched(out):
    assert len(out) == len(TEXTS) + 2
    assert text(out, 0) is None and next(r.n_entities for r in out if r.doc_id == 0) is None
    assert text(out, 1) == "" and text(out, 2) == TEXTS[2]


def test_mail(out):
    a, b = re.findall(r"\S+@[^\s,]+\w", text(out, 3))
    assert a.lower() == b.lower() and re.fullmatch(r"[a-z]{4}\.[a-z]{5}\+[a-z]@[a-z]{4}\d\.example\.(com|net|org)", a.lower())
    assert "smith" not in text(out, 3).lower()


def test_phone_keeps_format_and_identity(out):
    m = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1-(\d{3})-(\d{3})-(\d{4}); also \((\d{3})\) (\d{3})-(\d{4})\.", text(out, 4))
    assert m and m.group(1, 2, 3) == m.group(4, 5, 6) != ("915", "555", "2271")
    assert len({r.text for r in out if r.doc_id in (4, None)}) == 1


def test_cards(out):
    a, b, c = re.findall(r"\d(?:[ ]?\d){15}", text(out, 5))
    assert a.replace(" ", "") == b != c and luhn(b) and b[0] == c[0] == "4" and a.count(" ") == 3
    assert b != "4545400439450384"


def test_addresses_and_near_misses(out):
    found = re.findall(r"\d+\.\d+\.\d+\.\d+", text(out, 6))
    assert found[0] != "10.1.2.3" and "192.168.0.17." not in text(out, 6)
    assert text(out, 6).endswith(" Not 1.2.3 nor 999.1.1.1 nor 1.2.3.4.5")
    assert not text(out, 7).startswith("SSN 123-45-6789") and text(out, 7).endswith("but not 9123-45-67890 or A555-123-4567.")


def test_iban(out):
    a, b = re.fullmatch(r"IBAN (GB[A-Z\d ]+) and (DE\d+)", text(out, 8)).groups()
    assert iban_ok(a) and iban_ok(b) and a != "GB82 WEST 1234 5698 7654 32" and [len(x) for x in a.split()] == [4, 4, 4, 4, 4, 2]


def test_names_match_gender_and_script(out):
    m = re.fullmatch(r"Mrs (\w+ \w+) met Mr (\w+ \w+) and Frau (\w+ \w+); Mr (\w+ \w+) too\. Mrs (\w+ \w+) left\.", text(out, 9))
    first, john, capitals, ivan, again = m.groups()
    assert first == again and first.upper() == capitals and all(w.endswith("a") for w in first.split())
    assert all(w.endswith("o") for w in john.split()) and re.fullmatch(r"[А-Яа-я]+ [А-Яа-я]+", ivan)
    assert not {"anna", "schmidt", "john", "smith", "иван"} & set(re.findall(r"\w+", text(out, 9).lower()))


def test_coreference_of_names(out):
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. Later Mr (\w+) left\. (\w+) (\w+) paid; (\w+)'s car, Smithson stayed\. "
                     r"Dr\. (\w+) (\w+) and Prof (\w+) met Frau (\w+)\. (\w+) left\. Write to (\S+)", text(out, 10))
    john, smith, short, john2, smith2, capitals, anna, weber, klein, frau, plain, mail = m.groups()
    assert john == john2 != smith == short == smith2 and capitals == smith.upper() and john != "John" and smith != "Smith"
    assert weber == frau == plain and weber.endswith("a") and anna != "Anna" and klein.endswith("e") and "Weber" not in mail
    assert next(r.n_entities for r in out if r.doc_id == 10) == 6


def test_phones_with_and_without_country_code(out):
    found = [re.sub(r"\D", "", x) for x in re.findall(r"\+?\(?\d[\d ()+-]*\d", text(out, 11))]
    assert [len(x) for x in found] == [11, 10, 10, 11, 12] and len({x[-9:] for x in found}) == 2
    assert found[0][-9:] == found[1][-9:] == found[2][-9:] != "155552271" and found[3][-9:] == found[4][-9:] != "712345678"
    assert found[0][0] == "1" and found[4].startswith("49")


def test_private_addresses_stay_private(out):
    assert re.match(r"Host 10\.\d+\.\d+\.\d+, 192\.168\.\d+\.\d+\.", text(out, 6))


def test_full_spaces_swap_places(spark):
    rows = [("phone", str(n)) for n in range(10, 100)] + [("phone", "0")] + [("name", w) for w in ("anna", "belo", "bela")]
    got = surrogates.assign(spark.createDataFrame(rows, "kind string, canon string"), KEY, rounds=13).collect()
    assert sorted((r.kind, r.canon) for r in got) == sorted(rows)
    assert len({(r.kind, r.made) for r in got}) == len(rows) and all(r.made != r.canon for r in got)
    assert all(len(r.made) == len(r.canon) for r in got if r.kind == "phone")


def test_whole_query_is_a_consistent_renaming(spark):
    """Over sf0.001: equal originals have equal surrogates everywhere, different ones different, nothing else changes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    new = {r.doc_id: r.text for r in surrogates.replace(docs, KEY).collect()}
    mapping = {}
    matches = docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit(surrogates.PATTERN), 0).alias("found"))
    changed = 0
    for r in matches.collect():
        if r.text is None or not r.found:
            assert new[r.doc_id] == r.text
            continue
        if any(re.match(surrogates._LEAD.replace("(?U)", ""), f) for f in r.found):
            continue  # names are words, tested above
        at, pattern = 0, ""
        for f in r.found:
            i = r.text.index(f, at)
            pattern += re.escape(r.text[at:i]) + "(.{%d,})" % 1 if "@" in f else re.escape(r.text[at:i]) + "(.{%d})" % len(f)
            if surrogates_kind(f) == "ip":
                pattern = pattern[:pattern.rindex("(")] + r"([\d.]+)"
            at = i + len(f)
        m = re.fullmatch(pattern + re.escape(r.text[at:]), new[r.doc_id], re.S)
        assert m
        for old, made in zip(r.found, m.groups()):
            key = (surrogates_kind(old), re.sub(r"[^0-9a-z]", "", old.lower())[-(9 if surrogates_kind(old) == "phone" else 99):])
            value = re.sub(r"[^0-9a-z]", "", made.lower())[-(9 if key[0] == "phone" else 99):]
            assert mapping.setdefault(key, value) == value
            changed += 1
    assert len({(k, v) for (k, _), v in mapping.items()}) == len(mapping) and (changed == 0 or all(k[1] != v for k, v in mapping.items()))


def surrogates_kind(found):
    if "@" in found:
        return "email"
    if re.match(r"[A-Z]{2}\d{2}", found):
        return "iban"
    if re.fullmatch(r"\d+(\.\d+){3}", found):
        return "ip"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", found):
        return "ssn"
    return "phone" if found[0] in "+(" or len(re.sub(r"\D", "", found)) < 13 else "card"


def test_key_decides(spark, out):
    docs = spark.createDataFrame([(4, TEXTS[4])], "doc_id long, text string")
    assert surrogates.replace(docs, KEY).first().text == text(out, 4)
    assert surrogates.replace(docs, "other").first().text != text(out, 4)


def test_surrogates_are_distinct_and_no_originals(spark):
    # 300 of the 1,000 numbers with the same first digit: drawing alone would collide.
    rows = [("phone", str(1000 + i)) for i in range(300)] + [("ssn", f"9{i:08d}") for i in range(200)]
    entities = spark.createDataFrame(rows, "kind string, canon string")
    got = surrogates.assign(entities, KEY).collect()
    assert sorted((r.kind, r.canon) for r in got) == sorted(rows)
    made = {(r.kind, r.made) for r in got}
    assert len(made) == len(rows) and not made & set(rows)


def test_native_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    made = surrogates.replace(empty, KEY)
    assert made.collect() == []
    plan = empty.select(surrogates.kind_of(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in made._jdf.queryExecution().executedPlan().toString()
