"""Base spans against plain patterns on odd texts; disclosure against counts by hand."""

import hashlib
import math
import random
import re


from conftest import SF_SMALL
from sentiforge.llm import disclosure as ds

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return sum(s[0::2] + [sum(divmod(2 * x, 10)) for x in s[1::2]]) % 10 == 0


def plain(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def base(r):
    return [(k, s["start"], s["end"]) for k in ds.KINDS for s in r[k]]


def odd_texts():
    rng = random.Random(4)
    atoms = ["a", "Z9", "@", ".", "-", "_", "%", "+", "1", "25", "255", "256", "0", "00", " ", "(", ")", "\n", "é", "日", "😀",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (555) 123-4567", "10.0.0.1", "a@b.co",
             "x.y@z-1.org", "1.2.3.4.5.6.7.8", "@@", "a@b", "+49", "--", "  "]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    texts += [None, "", "a@b.c_d@x.y", "a@b.c-d_e@f.g.h", "007.08.9.10", "1" * 13, "0" * 16, "0" * 20, "1" * 5000 + "@" + "b.c",
              ("1 " * 3000), "." * 3000 + "a@b.cc", "a" * 20000, "+1" + "(" * 20000, "1." * 5000, "a@" * 5000, "a.b@c." * 300]
    return texts


def test_base_spans(spark):
    rows = [(i, t, "x") for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, email string").select("doc_id", "text")
    got = {r["doc_id"]: r for r in ds.sensitive_spans(docs, support=10**6).collect()}
    for i, t, _ in rows:
        assert base(got[i]) == plain(t), repr(t[:200])


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = ds.op2_disclosure(spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        want = plain(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{z}" for k, a, z in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ds.KINDS] == [sum(w[0] == k for w in want) for k in ds.KINDS]
        assert r["spans"] == listed or r["n_term"] > 0 and r["spans"].startswith(listed)


def corpus():
    rows = [(i, f"line one.\nPlease ask Quillfeather about case {i}, write to q.f@example.org today no{i}") for i in range(4)]
    rows += [(10, "Quillfeather was seen, quillfeather again; Quillfeathers not. q.f@example.org")]
    rows += [(20 + i, "Please write a case report about the weather today") for i in range(60)]
    rows += [(100 + i, "copied Zanzibarium then call z@copy.net now") for i in range(9)]
    return rows + [(200, None), (201, ""), (None, "q.f@example.org Quillfeather")]


def test_disclosing_terms(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ds.sensitive_spans(docs).collect()}
    text = dict(rows)
    found = {k: [text[k][s["start"]:s["end"]] for s in r["term"]] for k, r in got.items()}
    assert found[0] == found[None] == ["Quillfeather"]
    assert found[10] == ["Quillfeather", "quillfeather"]
    assert all(not found[k] for k in found if k is not None and 11 <= k <= 210)  # clean, or copies of one passage
    rows_ = ds._keyed(docs, "doc_id", "text").select("_k", "_t")
    entity = ds.entities(rows_, "_t", "_k")
    score = {(r["value"], r["term"]): r["disclosure"] for r in ds.disclosing_terms(rows_, entity, "_t", "_k", threshold=-9.0).collect()}
    n = len(rows)
    for term, both, everywhere in (("quillfeather", 6, 6), ("today", 4, 64), ("about", 4, 64)):
        if ("q.f@example.org", term) in score:
            want = math.log(both * n / (everywhere * 6)) / math.log(n / 6)
            assert abs(score["q.f@example.org", term] - want) < 1e-9
    assert ("q.f@example.org", "quillfeather") in score


def test_sanitised(spark):
    docs = spark.createDataFrame([(k, t, "s") for k, t in corpus()], "doc_id long, text string, _base string")
    got = {r["doc_id"]: r["text"] for r in ds.sanitised(docs).collect()}
    assert got[0] == "line one.\nPlease ask [TERM] about case 0, write to [EMAIL] today no0"
    assert got[25] == "Please write a case report about the weather today" and got[200] is None and got[201] == ""
    assert got[100] == "copied Zanzibarium then call [EMAIL] now"
    assert ds.sanitised(docs).columns == docs.columns
    assert ds.sanitised(docs.limit(0)).count() == 0 and ds.sensitive_spans(docs.limit(0)).count() == 0
    cards = spark.createDataFrame([(1, "a 4111 1111 1111 1111 b 4111 1111 1111 1112 c 300.1.1.1 10.0.0.1 +1 555 123 4567")],
                                  "doc_id long, text string")
    assert ds.sanitised(cards).first()["text"] == "a [CARD] b 4111 1111 1111 1112 c 300.1.1.1 [IP] [PHONE]"


SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qi ro su ta ve wi xo yu za".split()


def planted(seed=3, people=12):
    """Documents of ordinary prose; each person's name, short name and number stand on other lines than the address."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(SYLLABLES) for _ in range(n))
    common, rare = [word(2) for _ in range(150)], [word(4) for _ in range(4000)]

    def prose(n):
        ws = [rng.choice(common) if rng.random() < .85 else rng.choice(rare) for _ in range(n)]
        return " ".join(w.capitalize() if i % 9 == 0 else w for i, w in enumerate(ws)) + "."

    rows, names = [], {}
    for p in range(people):
        own = [word(3).capitalize() + "vyn", rng.choice(["Lee", "Bo", "Kim", "Ng"]) + word(1)[:1] + str(p % 2 or ""), f"AB{rng.randrange(10**5, 10**6)}", "王" + chr(0x4E00 + 37 * p)]
        names[p] = own
        mail = f"user{p}@example{p % 3}.org"
        for d in range(rng.choice([3, 4, 8, 30])):
            body = f"{prose(25)}\n{own[0]} {own[1]}\n{prose(30)} wrote about case {d} this week\nno. {own[2]}, {own[3]}\n{prose(12)}\n\n{mail}"
            rows.append((1000 * p + d, body))
    rows += [(100_000 + i, prose(rng.randrange(20, 90))) for i in range(1500)]
    form = prose(60)
    near = [form + f"\n{prose(3)}\nform@copies.net" for _ in range(25)]        # near copies with one address
    rows += [(200_000 + i, t) for i, t in enumerate(near)]
    rng.shuffle(rows)
    return rows, names


def test_names_on_other_lines_go_and_words_stay(spark):
    rows, names = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    text = dict(rows)
    asked = caught = wrong = 0
    for r in ds.sensitive_spans(docs).collect():
        got = {text[r["doc_id"]][s["start"]:s["end"]] for s in r["term"]}
        want = set(names[r["doc_id"] // 1000]) if r["doc_id"] < 100_000 else set()
        asked, caught, wrong = asked + len(want), caught + len(want & got), wrong + len(got - want)
    print("terms", asked, "found", caught, "wrong", wrong)
    assert caught >= 0.95 * asked and wrong <= 0.01 * asked


def test_an_entity_in_one_text_has_no_terms(spark):
    t = "Quillfeather Zanzibarium\nwrite to q.f@example.org"
    docs = spark.createDataFrame([(i, t) for i in range(40)] + [(100 + i, "some other words here") for i in range(60)],
                                 "doc_id long, text string")
    assert all(not r["term"] for r in ds.sensitive_spans(docs).collect())


def test_columns_with_clashing_names(spark):
    extra = ["_t", "_k", "_terms", "_key", "_m_email", "_g_ip", "_base", "email", "kind"]
    rows = [(k, t, *[f"{c}{k}" for c in extra]) for k, t in corpus()] + [(7, "x " * 60_000 + "a@b.cc", *extra)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    got = ds.sanitised(docs)
    assert got.columns == docs.columns
    left = sorted((r["doc_id"] or -1, *[r[c] for c in extra]) for r in got.collect())
    assert left == sorted((r[0] or -1, *r[2:]) for r in rows)


def test_nothing_broadcast_changes_nothing(spark, monkeypatch):
    rows, _ = planted(people=4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = []
    for limit in (ds.BROADCAST_BYTES, -1):
        monkeypatch.setattr(ds, "BROADCAST_BYTES", limit)
        both.append(sorted(map(tuple, ds.sanitised(docs).collect())))
    assert both[0] == both[1]


def test_an_entity_with_many_words_of_its_own_keeps_them(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(2))
    own = [f"Name{chr(97 + i)}vyn" for i in range(ds.OWN_WORDS + 4)]
    passage = "Zanzibarium Quillfeather Ostrogard Pellimore Wexcombe Thornaby Aldermoor Finchley Brackenfell Umberleigh Corvane"

    def mixed(words):
        return " ".join(w for x in words for w in [x, *(word() for _ in range(6))])

    rows = [(i, f"{mixed(rng.sample(own, len(own)))} many@names.org") for i in range(20)]
    rows += [(100 + i, f"{' '.join(word() for _ in range(30))} {passage} one@copy.net {word()}") for i in range(20)]
    rows += [(1000 + i, " ".join(word() for _ in range(60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    for r in ds.sensitive_spans(docs).collect():
        found = {text[r["doc_id"]][s["start"]:s["end"]] for s in r["term"]}
        assert found == (set(own) if r["doc_id"] < 100 else set())
