import re

from pyspark.sql import functions as F

from kmerloom.llm.common import Scratch
from kmerloom.llm.pii import kind_of, replace_pii, surrogates

TEXT = (
    "Mr. Smith wrote to jo.ann_7@mail.example.org and JO.ANN_7@mail.example.org; Mrs. Anna Kovács called +1 (555) 010-2233 from 10.20.30.40. "
    "Card 4111 1111 1111 1111, bad card 4111111111111112, ssn 078-05-1120, iban DE89370400440532013000. г-жа Петрова ответила. Mr. Smith again; v1.2.3.4.5 stays, 3.14 too."
)


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def mentions(frame, text):
    (r,) = replace_pii(frame([(1, text)]), "k", with_originals=True).collect()
    return [(e["entity"], e["surrogate"]) for e in r["entities"]], r["text"]


def test_one_person_by_all_names(frame):
    found, new = mentions(frame, "Mr. John Smith came. Mr. Smith sat. Smith said that John Smith knew Dr. Jane Roe, and Mrs. Jane Roe knew Smithson. Jane Roe left; Roe's hat stayed.")
    of = dict(found)
    assert list(of) == ["Mr. John Smith", "Mr. Smith", "Smith", "John Smith", "Dr. Jane Roe", "Mrs. Jane Roe", "Jane Roe", "Roe"]
    smith, roe = of["Smith"], of["Roe"]
    john, jane = of["John Smith"].split()[0], of["Jane Roe"].split()[0]
    assert smith != roe and of["Mr. John Smith"] == f"Mr. {john} {smith}" and of["Mr. Smith"] == f"Mr. {smith}" and of["John Smith"] == f"{john} {smith}"
    assert of["Dr. Jane Roe"] == f"Dr. {jane} {roe}" and of["Mrs. Jane Roe"] == f"Mrs. {jane} {roe}"
    from kmerloom.llm.pii import GIVEN

    assert john in GIVEN["m", "latin"] and jane in GIVEN["f", "latin"]
    assert "Smithson" in new and not re.search(r"\b(?:Smith|Roe|John|Jane)\b", new) and re.fullmatch("[A-Z][a-z]+", smith)


def test_one_number_however_it_is_written(frame):
    text = "+1 (555) 010-2233, +1 555 010 2233 and 4111111111111111, 4111 1111 1111 1111; 078-05-1120. JO@x.com, jo@x.com, Jo@X.COM"
    found, _ = mentions(frame, text)
    got = [re.sub(r"\D", "", s) if "@" not in s else s for _, s in found]
    assert got[0] == got[1] and got[2] == got[3] and luhn(got[2]) == 0 and got[0][0] == "1"
    assert [re.sub("[0-9]", "9", s) for _, s in found[:5]] == [re.sub("[0-9]", "9", e) for e, _ in found[:5]]
    a, b, c = got[5:]
    assert a.lower() == b == c.lower() and a.split("@")[0].isupper() and c[:2].istitle()
    again, _ = mentions(frame, "DE89370400440532013000 and DE89370400440532013001")
    assert [mod97(s) == 1 for _, s in again] == [True, False] or mod97(again[0][1]) == 1


def test_many_mentions_of_one_entity(frame):
    rows = [(k, f"write to all@x.example or u{k}@x.example") for k in range(400)]
    got = replace_pii(frame(rows), "k").collect()
    assert len({r["entities"][0]["surrogate"] for r in got}) == 1 and len({r["entities"][1]["surrogate"] for r in got}) == 400


def test_long_text(frame):
    text = "plain words " * 200_000 + "Mr. Smith " + "and Smith wrote to a1@b.example " * 2_000
    found, new = mentions(frame, text)
    assert len(found) == 4_001 and len(dict(found)) == 3 and "Smith" not in new and new.startswith("plain words " * 200_000)


def test_surrogates_of_a_text(frame):
    (r,) = replace_pii(frame([(1, TEXT)]), "k", with_originals=True).collect()
    found = [(e["kind"], e["entity"], e["surrogate"]) for e in r["entities"]]
    assert [k for k, _, _ in found] == ["name", "email", "email", "name", "phone", "ip", "card", "card", "ssn", "iban", "name", "name"]
    of = {e: s for _, e, s in found}
    assert len(set(of.values())) == len(of) and not set(of) & set(of.values())
    at, out = 0, ""
    for _, e, s in found:
        k = TEXT.index(e, at)
        out, at = out + TEXT[at:k] + s, k + len(e)
    assert r["text"] == out + TEXT[at:] and r["n_entities"] == len(found)
    assert luhn(of["4111 1111 1111 1111"]) == 0 and re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", of["4111 1111 1111 1111"])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", of["+1 (555) 010-2233"]) and re.fullmatch(r"\d{3}-\d{2}-\d{4}", of["078-05-1120"])
    assert all(0 <= int(x) < 256 for x in of["10.20.30.40"].split("."))
    assert re.fullmatch(r"[A-Z]{2}\.[A-Z]{3}_\d@example\.(com|net|org)", of["JO.ANN_7@mail.example.org"])
    assert of["Mr. Smith"].startswith("Mr. ") and of["Mrs. Anna Kovács"].startswith("Mrs. ") and of["г-жа Петрова"].startswith("г-жа ")
    from kmerloom.llm.pii import GIVEN

    assert len(of["Mr. Smith"].split()) == 2 and of["Mrs. Anna Kovács"].split()[1] in GIVEN["f", "latin"] and re.fullmatch("[А-Я][а-я]+а", of["г-жа Петрова"].split()[1])
    assert of["jo.ann_7@mail.example.org"].split("@")[0].upper() == of["JO.ANN_7@mail.example.org"].split("@")[0] and mod97(of["DE89370400440532013000"]) == 1
    assert "v1.2.3.4.5 stays, 3.14 too" in r["text"]
    (plain,) = replace_pii(frame([(1, TEXT)]), "k").collect()
    assert plain["text"] == r["text"] and not any(e in str(plain) for e in of)


def test_same_entity_same_surrogate_and_keys_differ(frame):
    rows = [(1, "a@b.example.com"), (2, "see a@b.example.com!"), (2, "see a@b.example.com!")]
    one = [r["entities"][0]["surrogate"] for r in replace_pii(frame(rows), "k").collect()]
    assert len(set(one)) == 1 and one == [r["entities"][0]["surrogate"] for r in replace_pii(frame(rows).repartition(3), "k").collect()]
    assert one[0] != replace_pii(frame(rows), key="other").collect()[0]["entities"][0]["surrogate"]


def test_collisions_are_drawn_again(spark):
    """More entities of one small format than it has surrogates."""
    rows = [("email", f"{a}@h{n}.example.com") for a in "abcdefghijklmnopqrstuvwxyz" for n in range(6)]
    got = surrogates(Scratch(spark, "test"), spark.createDataFrame(rows * 2, "kind string, entity string"), "k").collect()
    assert len(got) == len(rows) == len({r["entity"] for r in got}) == len({r["surrogate"] for r in got})
    assert not {r["entity"] for r in got} & {r["surrogate"] for r in got}


def test_odd_rows_and_kinds(spark, frame, odd_rows):
    got = replace_pii(frame(odd_rows, clash=True), "k").collect()
    assert sorted(((r["doc_id"], r["text"], r["n_entities"]) for r in got), key=str) == sorted(((i, t, 0) for i, t in odd_rows), key=str)
    assert replace_pii(frame([]), "k").count() == 0
    kinds = spark.createDataFrame([("1.2.3.4",), ("4111111111111111",), ("078-05-1120",)], "e string").select(kind_of(F.col("e")).alias("k")).collect()
    assert [k["k"] for k in kinds] == ["ip", "card", "ssn"]
