from __future__ import annotations

import os
import re

import pytest

from veldspan.llm import queries as q
from veldspan.llm import surrogates as s

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def mod97(iban: str) -> int:
    x = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def texts(spark, *rows, secret="k"):
    df = spark.createDataFrame(list(enumerate(rows)), SCHEMA)
    return {r["doc_id"]: r for r in s.pseudonymize(df, secret).collect()}


def test_formats_stay_and_decoys_are_left_alone(spark):
    out = texts(
        spark, "a Jo.D-9@mail.example.org b", "call +1 (743) 555-3824 or 743-555-3824", "ip 97.51.17.173, no 300.1.1.1, no 1.2.3.4.5",
        "7536784127813050 4845168114407329 4111-1111-1111-1111 4485168114407320", "DE89 3704 0044 0532 0130 00 DE89 3704 0044 0532 0130 01", None, "", "Plain words only.",
    )
    assert re.fullmatch(r"a [A-Za-z]{2}\.[A-Za-z]-\d@[a-z]{4}\.example\.org b", out[0]["text"]) and "Jo.D-9" not in out[0]["text"]
    a, b = re.fullmatch(r"call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})", out[1]["text"]).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "7435553824"
    assert re.fullmatch(r"ip \d+\.\d+\.\d+\.\d+, no 300\.1\.1\.1, no 1\.2\.3\.4\.5", out[2]["text"]) and out[2]["n_ip"] == 1
    first, card, dashed, last = out[3]["text"].split()
    assert (first, last) == ("7536784127813050", "4485168114407320")
    assert luhn(card) and card[0] == "4" and len(card) == 16 and luhn(dashed.replace("-", "")) and re.fullmatch(r"\d{4}(-\d{4}){3}", dashed)
    good, bad = out[4]["text"][:27], out[4]["text"][28:]
    assert mod97(good) == 1 and good != "DE89 3704 0044 0532 0130 00" and bad == "DE89 3704 0044 0532 0130 01"
    assert out[5]["text"] is None and out[6]["text"] == "" and out[7]["text"] == "Plain words only." and out[7]["n_entities"] == 0


def test_coreference_gender_and_script(spark):
    out = texts(
        spark, "Mr. John Smith met Mrs. Smith. SMITH left; Smith came. Smithson stayed.", "Dr. Jennifer Smith", "г-н Иванов и г-жа Иванова. Иванов ушел", "Smith alone",
        "Herr Klaus Weber; Frau Monika Weber",
    )
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+)\. (\w+) left; (\w+) came\. Smithson stayed\.", out[0]["text"]).groups()
    assert m[1] == m[2] == m[4] == m[3].capitalize() != "Smith" and m[3].isupper() and m[0] in s.GIVEN["m", "latin"]
    given, surname = re.fullmatch(r"Dr\. (\w+) (\w+)", out[1]["text"]).groups()
    assert surname == m[1] and given in s.GIVEN["f", "latin"]
    m = re.fullmatch(r"г-н (\w+) и г-жа (\w+)\. (\w+) ушел", out[2]["text"]).groups()
    assert m[0] == m[2] and m[1] == m[0] + "а" and re.fullmatch(r"[А-Яа-я]+", m[0]) and m[0] != "Иванов"
    assert out[3]["text"] == "Smith alone"
    a, b = re.fullmatch(r"Herr (\w+ \w+); Frau (\w+ \w+)", out[4]["text"]).groups()
    assert a.split()[0] in s.GIVEN["m", "latin"] and b.split()[0] in s.GIVEN["f", "latin"] and a.split()[1] == b.split()[1]


def test_names_stay_distinct_and_one_whatever_the_title(spark):
    given = ["Alex", "Terry", "Robin", "Sasha", "Kim", "Jo", "Max", "Sam", "Charlie", "Quinn", "Lee", "Pat"]
    rows = [f"{t} {g} Kimball" for t in ("Mr.", "Dr.", "Mrs.", "Mx.") for g in given] + ["Dr. Lee Alexander", "Dr. Alexander Lee"]
    out = texts(spark, *rows)
    got = {r: out[i]["text"].split() for i, r in enumerate(rows)}
    names = {g: {got[r][1] for r in rows if r.split()[1:] == [g, "Kimball"]} for g in given}
    assert all(len(x) == 1 for x in names.values())  # coreference
    assert len(set.union(*names.values())) == len(given)  # distinctness, across titles
    assert len({got[r][2] for r in rows[:-2]}) == 1
    (a, b), (c, d) = got[rows[-2]][1:], got[rows[-1]][1:]
    surrogates = [x.lower() for x in (*set.union(*names.values()), got[rows[0]][2], b, c, d)]
    assert len(set(surrogates)) == len(surrogates) and {a} == names["Lee"]  # nor is a given name a surname's surrogate


def test_gender_is_what_most_titles_say(spark):
    out = texts(spark, "Mr. Robin Ashdown", "Mr. Robin Brent", "Mrs. Robin Crewe", "Dr. Robin Dale", "Dr. Toni Dale", "Frau Toni Ashdown")
    first = {out[i]["text"].split()[1] for i in range(4)}
    assert len(first) == 1 and first <= set(s.GIVEN["m", "latin"])
    assert {out[i]["text"].split()[1] for i in (4, 5)} <= set(s.GIVEN["f", "latin"])


def test_names_by_context(spark):
    out = texts(
        spark, "My name is Priya Sharma and I work. Sharma left.", "Contact Wei Zhang today", "signed by Ngozi Okafor-Bello.", "Later Wei Zhang said no.", "Priya Sharma <p.s@x.org>",
        "The President said no. General Public License. Apache License was", "By To By To of the Wei Zhang Foundation", "name: Chukwuemekatobechukwuchineduikechukwuolisaemekanwachukwu Ikechukwu-Ezeani",
    )
    m = re.fullmatch(r"My name is (\w+) (\w+) and I work\. (\w+) left\.", out[0]["text"]).groups()
    assert m[1] == m[2] != "Sharma" and m[0] != "Priya"
    wei = re.fullmatch(r"Contact (\w+ \w+) today", out[1]["text"])[1]
    assert wei != "Wei Zhang" and re.fullmatch(rf"Later {wei} said no\.", out[3]["text"])
    assert "Okafor" not in out[2]["text"] and "Ngozi" not in out[2]["text"]
    assert re.fullmatch(rf"{m[0]} {m[1]} <\S+@\S+>", out[4]["text"])
    assert out[5]["text"].startswith("The President said no. General Public License.") and out[6]["n_entities"] == 0
    assert "Chukwu" not in out[7]["text"] and out[7]["n_person"] == 1


def test_many_persons_in_one_text_against_brute_force(spark):
    """Every surname that the text gives is replaced wherever it stands alone, and nothing else changes."""
    import random

    rng = random.Random(8)
    surnames = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).capitalize() for _ in range(300)]
    parts = [f"Mr. {x} came." for x in surnames[:150]] + [f"{x} went." for x in surnames] + [f"{x}ov stayed." for x in surnames[:50]]
    rng.shuffle(parts)
    text = " ".join(parts)
    out = texts(spark, text)[0]
    known = set(surnames[:150])
    before, after = re.findall(r"\w+|\W+", text), re.findall(r"\w+|\W+", out["text"])
    assert len(before) == len(after)
    names = {}
    for x, y in zip(before, after, strict=True):
        if x in known:
            assert names.setdefault(x, y) == y != x
        else:
            assert x == y
    assert len(set(names.values())) == len(known) and out["n_person"] == sum(x in known for x in before)


def test_secret_is_in_no_plan(spark):
    df = spark.createDataFrame([(1, "Mr. John Smith 97.51.17.173")], SCHEMA)
    out = s.pseudonymize(df, "very-secret-value")
    assert "very-secret-value" not in out._jdf.queryExecution().toString()
    pieces = spark.createDataFrame([("ip", "1.1.1.1", "u", 0)], "kind string, norm string, gender string, attempt int")
    key = spark.createDataFrame([("very-secret-value",)], "secret string")
    plan = pieces.crossJoin(key).withColumn("sur", s.surrogate())._jdf.queryExecution()
    assert "very-secret-value" not in plan.toString() and "secret" in plan.toString()


def test_distinct_entities_stay_distinct_in_a_tiny_space(spark):
    mails = [f"{a}@b.com" for a in "abcdefghijklmnopqrstuvwxyz"] + [f"{n}@b.com" for n in range(10)]
    out = texts(spark, " ".join(mails), " ".join(reversed(mails)))
    got = out[0]["text"].split()
    assert len(set(got)) == len(mails) and not set(got) & set(mails)
    assert out[1]["text"].split() == got[::-1]


def test_keyed_and_repeatable(spark):
    row = "x 97.51.17.173 y"
    assert texts(spark, row)[0]["text"] == texts(spark, row)[0]["text"] != texts(spark, row, secret="it's \\ other")[0]["text"]


def test_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert s.pseudonymize(empty, "k").collect() == []
    rows = [(None, "97.51.17.173", 1, "z"), (None, "97.51.17.173", 1, "z"), (1, None, 2, "z"), (1, "a." * 60_000 + "@x.y 1.1.1.1 " + "9" * 50_000, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, kind string").withColumnRenamed("text", "body")
    out = s.pseudonymize(df, "k", text="body").collect()
    assert len(out) == 4 and [r["n_entities"] for r in out if r["doc_id"] is None] == [1, 1]
    long = max((r for r in out if r["text"]), key=lambda r: len(r["text"]))
    assert long["n_ip"] == 1 and long["text"].startswith("a." * 60_000)


def test_whole_table_against_patterns(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in q.op8_pii_surrogates(spark, SF).collect()}
    assert set(out) == set(before)
    plain = re.compile(r"[\w.]+@\w+\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<![0-9A-Za-z])4\d{15}(?![0-9A-Za-z])")
    for k, t in before.items():
        hits = [m for m in plain.findall(t) if not m.isdigit() or luhn(m)]
        assert out[k]["n_entities"] == len(hits), k
        assert (out[k]["text"] == t) == (not hits)
        assert not any(h in out[k]["text"] for h in hits)
