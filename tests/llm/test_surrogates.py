import itertools
import re

import pytest

from plumbline.llm import surrogates as S

KEY = b"test"


def test_permutations_are_one_to_one_without_fixed_points():
    use = S.Surrogates(KEY)
    for sizes in ([10, 26], [2], [8, 10, 10], [21, 5, 1], [256]):
        values = list(itertools.product(*map(range, sizes)))
        made = [tuple(use.permute(list(v), sizes, "t")) for v in values]
        assert sorted(made) == values and all(a != b for a, b in zip(values, made, strict=True))
    assert use.permute([1, 2], [10, 26], "t") != S.Surrogates(b"other").permute([1, 2], [10, 26], "t")
    long_ = use.permute([3] * 500, [10] * 500, "t")
    assert len(long_) == 500 and long_ != [3] * 500


def test_formats_stay():
    use = S.Surrogates(KEY)
    text = 'Jo.Smith+9@Mail4.example.com +1 (407) 555-7710### 4111 1111 1111 1111, 10.2.3.4. GB82 WEST 1234 5698 7654 32 token = "24BE64439E3E49CF46B2" 123-45-6789'
    new, made = use.replace(text)
    shape = lambda t: re.sub(r"\d+", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", t)))
    assert shape(re.sub("token.*?\" ", "", new)) == shape(re.sub("token.*?\" ", "", text))
    assert [kind for kind, _, _ in made] == ["email", "phone", "card", "ip", "iban", "secret", "ssn"]
    assert not any(old in new for old in ("Smith", "407", "4111 1111 1111 1111", "10.2.3.4", "1234 5698", "24BE64", "123-45"))
    card = [int(c) for c in re.search(r"### ([\d ]+),", new)[1] if c.isdigit()]
    assert S.luhn(card[:-1]) == card[-1]
    iban = re.search(r"GB\d\d [A-Z0-9 ]{22}", new)[0].rstrip()
    assert S.iban_check("GB", re.sub(" ", "", iban)[4:22]) == iban[2:4]
    assert "(" in new and "+1 (" in new


def test_coreference_and_distinctness():
    use = S.Surrogates(KEY)
    _, made = use.replace("ann@x.org ANN@X.ORG bob@x.org 4111111111111111 4111 1111 1111 1111")
    assert made[0] == made[1] != made[2] and made[3][2] == made[4][2]
    assert made[0][2].split("@")[1] == made[2][2].split("@")[1]


def test_names_keep_gender_and_script():
    use = S.Surrogates(KEY)
    new, made = use.replace("Anna Schmidt wrote to Dr. Müller, Иван Петров and John O'Neil; Anna Schmidt left. Anna left, anna stayed.")
    first = new.split()[0]
    assert first in S.GIVEN_NAMES["female Latin"] and first != "Anna"
    assert new.endswith(f"{first} left, anna stayed.") and sum(m == ("name", "anna", first.lower()) for m in made) == 3
    given, surname = re.search(r"to Dr\. \w+, (\w+) (\w+)", new).groups()
    assert given in S.GIVEN_NAMES["male Cyrillic"] and re.fullmatch("[А-Я][а-я]+", surname)
    assert not {"Schmidt", "Müller", "Петров"} & set(re.findall(r"\w+", new))


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "plain words 12 and 1.5", "x"), (3, "a.b@c.de " * 30_000, "y"), (None, "a.b@c.de", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_replaced string").repartition(2)
    kept = S.replace_pii(docs, KEY)
    assert kept.columns == docs.columns
    got = {r.doc_id if r.text else 0: r.text for r in kept.collect()}
    assert got[2] == "plain words 12 and 1.5" and "a.b@c.de" not in got[3] and got[3].startswith(got[None])
    counted = {r.text: r.n_replaced for r in S.replace_pii(docs.drop("n_replaced"), KEY, counts=True).collect() if r.text}
    assert counted[got[3]] == 30_000 and counted["plain words 12 and 1.5"] == 0
    assert S.replace_pii(docs.limit(0), KEY).count() == 0


def test_the_check_finds_both_failures(spark):
    pairs = [("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("d", "w"), ("e", "v"), ("f", "f"), ("c", "y")]
    done = spark.createDataFrame([(i, [{"entity": a, "surrogate": b}]) for i, (a, b) in enumerate(pairs)], "id long, m array<struct<entity:string,surrogate:string>>")
    assert {r.entity for r in S.failing_entities(done, "m").collect()} == {"b", "d"}


def test_failing_entities_take_another_round(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a@b.cd"), (2, "e@b.cd a@b.cd")], "doc_id long, text string")
    assert S.failing_entities(S.with_surrogates(docs, KEY, {}, "m"), "m").count() == 0
    before = {r.doc_id: r.text for r in S.replace_pii(docs, KEY).collect()}
    bad, calls = S.surrogates(KEY).seal("email", "e@b.cd"), []

    def check(done, made):
        calls.append(done)
        return spark.createDataFrame([(bad,)] if len(calls) < 3 else [], "entity string")

    monkeypatch.setattr(S, "failing_entities", check)
    after = {r.doc_id: r.text for r in S.replace_pii(docs, KEY).collect()}
    assert len(calls) == 3 and after[1] == before[1]
    old, new = before[2].split(), after[2].split()
    assert old[1] == new[1] and old[0] != new[0] and new[0] not in ("e@b.cd", new[1])
    with pytest.raises(ValueError):
        S.replace_pii(docs, KEY, max_rounds=0) if calls.clear() is None else None


#: Mentions of one entity in a row; what a list of its own must stay as it is.
SAME = [
    ["+49 170 1234567", "+491701234567", "0049 170 1234567", "+49 (0)170 1234567"],
    ["(407) 555-7710", "+1 407 555 7710", "407-555-7710", "+1 (407) 555-7710"],
    ["+44 20 7946 0958", "+442079460958"],
    ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"],
    ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"],
    ["2001:db8::8a2e:370:7334", "2001:0db8:0000:0000:0000:8a2e:0370:7334"],
    ["Ann.Lee@Mail.example.org", "ann.lee@mail.example.org", "ANN.LEE@MAIL.EXAMPLE.ORG"],
    ["Priya Sharma", "PRIYA SHARMA", "priya sharma"],
    ["Wei Zhang", "Wei\nZhang"],
    ["Olga Petrova"], ["Peter Paul Smith"], ["John A. Smith"], ["JOHN O'NEIL"], ["Hans von der Leyen"], ["Łukasz Řeřicha"], ["Иван Петров"],
    ["10.20.30.40"], ["123-45-6789"], ["24be64439e3e49cf46b224be64439e3e"],
]
CLEAN = ["9781234567890", "1234567890123456", "1700000000123", "4075557710", "10:30:25", "std::vector", "v1.2.3", "1,234.56", "GB82 WEST 1234 5698 7654 33", "the man", "In Berlin", "anna", "3.14", "2024-01-31"]


def same_shape(a, b):
    kind = lambda c: "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
    return [kind(c) for c in a] == [kind(c) for c in b]


def test_mentions_against_a_brute_force_of_known_places(spark):
    import random

    rng, rows, pieces = random.Random(7), [], {}
    for i in range(300):
        parts = [(rng.choice(CLEAN), None) if rng.random() < 0.5 else (lambda k: (rng.choice(SAME[k]), k))(rng.randrange(len(SAME))) for _ in range(rng.randint(1, 12))]
        pieces[i] = parts
        rows.append((i, " ; ".join(p for p, _ in parts)))
    known, owner = {}, {}
    canonical = lambda t: "".join(c for c in t.lower() if c.isalnum())
    got = {r.doc_id: r for r in S.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), KEY, counts=True).collect()}
    for i, parts in pieces.items():
        new = got[i].text.split(" ; ")
        assert len(new) == len(parts) and got[i].n_unchanged == 0
        for (old, k), made in zip(parts, new, strict=True):
            if k is None:
                assert made == old
                continue
            assert made != old and canonical(made) != canonical(old)
            assert known.setdefault((k, old), made) == made
            if k not in (7, 8, 9, 10, 11, 12, 13, 14, 15, 5, 16, 18):
                assert same_shape(old, made)
            #: What all spellings of an entity share: the last digits or letters.
            tail = canonical(made)[-6:] if k != 5 else canonical(made)[-8:]
            assert owner.setdefault(tail, k) == k
    by_entity = {k: {canonical(m)[-6:] for (e, _), m in known.items() if e == k} for k in range(len(SAME))}
    assert all(len(tails) == 1 for tails in by_entity.values()), by_entity


def test_every_script_gets_a_surrogate():
    use = S.Surrogates(KEY)
    for text in ("Dr 王小明", "Dr محمد علي", "Frau Dvořáková", "Mr Ñíguez", "Dr. שרה", "Herr Żółć", "Señora राधा"):
        new, made = use.replace(text)
        names = [old for _, old, _ in made]
        assert names and all(old != after for _, old, after in made)
        assert not any(set(old) <= set(new.lower()) and old in new.lower() for old in names), (text, new)
    assert use.replace("Dr. Müller and Frau Ivanova")[0].endswith("ova")


def test_planted_data_is_gone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in S.replace_pii(docs, KEY).collect()}
    forms = [r"\S+@[\w.]+", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b[0-9a-f]{40}\b"]
    n = 0
    for i, text in before.items():
        old = [set(re.findall(p, text)) for p in forms]
        n += sum(map(len, old))
        assert not any(x in after[i] for found in old for x in found)
        if not any(old) and not re.search(r"\d|@", text):
            assert after[i] == text
    assert n > 50
