"""Pattern spans against Python's matcher, and terms that disclose."""

import math
import random
import re

from pyspark.sql import functions as F

from specband.llm import pii
from tests.llm import brute

ODD = [
    "a@b.c+x@d.e.f- x@y x@y. .@-.- %@1.2.3.4", "1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.0003.255 9.9.9.9.9.9.9.9.9 1..2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4111 1111  1111 1111 0000000000000",
    "+1 (555) 010-0100 ++44 20 7946 0958 +1 +12 +123456789012345678 + 1234567890 +1-555-010-0199x", "é漢🙂 mail me@x.org 漢 +49 30 901820 8.8.8.8", "1" * 3000 + " " + "1 2 " * 500,
    "a" * 3000 + "@" + "b." * 300 + "c", "x@" + "a.b." * 800, "me@x.org,you@x.org;me@x.org", "+1(555)010-0100 4242424242424242 10.0.0.1", "1.2.3.4@h.i 5555555555554444@x.y",
]


def rows_of(df):
    return sorted((tuple(r)[:6] for r in pii.digest(df).collect()), key=str)


def test_patterns(make, odd_texts):
    rows = odd_texts + [(100 + i, t) for i, t in enumerate(ODD)]
    out = pii.sanitise(make(rows), keep=["lang", "in"])
    assert rows_of(out) == sorted(((d, *brute.pii(t)[0]) for d, t in rows), key=str)
    assert out.select("in.*").columns == ["lang", "in"]


def test_clean_text_and_terms(make):
    fill = [f"w{i} v{i} u{i} t{i} s{i}" for i in range(40)]
    docs = [(i, f"{fill[i]} {fill[i + 1]} Kestrel at a.b@c.org {fill[i + 2]} the {fill[i + 3]}") for i in range(6)]
    docs += [(10, "kestrel again, far from it: " + fill[20] + " " * 90 + "a.b@c.org"), (11, "the rest the end"), (12, None), (13, ""), (14, "Kestrel flies")]
    docs += [(1000 + i, f"the filler {i}") for i in range(200)]
    out = {r.doc_id: r for r in pii.sanitise(make(docs)).collect()}
    assert "Kestrel" not in out[0].clean_text and " the " in out[0].clean_text and "[EMAIL]" in out[0].clean_text
    assert out[10].clean_text.startswith("[TERM] again") and [s.k for s in out[10].added] == [4]
    assert out[14].clean_text == "Kestrel flies" and out[11].clean_text == "the rest the end" and out[12].clean_text is None and out[13].clean_text == ""
    spans = {r.doc_id: r.spans for r in pii.digest(pii.sanitise(make(docs))).collect()}
    assert spans[10].startswith("term:0:7,email:") and spans[11] == ""


def test_terms_anywhere_and_of_any_length(make):
    gap = lambda i: " ".join(f"g{i}x{k}" for k in range(30))
    docs = [(i, f"Merganser Li {gap(i)} write to a.b@c.org") for i in range(5)] + [(10 + i, f"a.b@c.org Garganey {gap(i + 5)} the end") for i in range(3)]
    docs += [(13 + i, f"a.b@c.org {gap(i + 8)} far off Garganey the end") for i in range(5)] + [(100 + i, f"the end {i}") for i in range(200)]
    out = {r.doc_id: r.clean_text for r in pii.sanitise(make(docs)).collect()}
    assert all("Merganser" not in out[i] and "Li" not in out[i].split() and gap(i) in out[i] for i in range(5))
    assert all("Garganey" not in out[10 + i] for i in range(8)) and out[10].endswith("the end")


def test_terms_against_plain_counting(make):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("xyz漢é") for _ in range(r.randrange(4, 30))) + r.choice(["", " m1@x.org", " m2@x.org m1@x.org", " 8.8.8.8 m2@x.org"])) for i in range(60)]
    docs += docs[:7] + [(100 + i, docs[3][1]) for i in range(4)]
    seen = [(set(re.findall(r"\w+", t)), {m for m in re.findall(r"m\d@x.org|8\.8\.8\.8", t)}) for _, t in docs]
    want = set()
    for e in ("m1@x.org", "m2@x.org", "8.8.8.8"):
        mine = [w for w, es in seen if e in es]
        for t in set().union(*mine):
            co, df, kinds = sum(t in w for w in mine), sum(t in w for w, _ in seen), len({frozenset(w) for w in mine if t in w})
            if kinds >= 3 and math.log2(co * len(docs) / (df * len(mine))) >= 0.8 * math.log2(len(docs) / len(mine)):
                want.add((e.replace(".", "") if e[0] == "8" else e, t, co == df))
    df = make(docs).withColumn("key", F.col("doc_id")).withColumn("base", pii.base_spans(F.col("text"))).where(F.size("base") > 0)
    got = pii.disclosing_terms(make(docs).select("text"), pii.mentions(df), 0.8, 3).collect()
    assert want and {(g.entity.v, g.term, g["all"]) for g in got} == want


def test_one_entity_in_most_documents(make):
    """Every document gets the terms it holds itself, however many its entity has elsewhere."""
    docs = [(i, f"a.b@c.org Kestrel{i % 40} pads{i} h{i // 3}") for i in range(200)] + [(1000 + i, f"other {i}") for i in range(900)]
    out = {r.doc_id: r for r in pii.sanitise(make(docs).repartition(7)).collect()}
    assert all([s.v for s in out[i].added] == [f"Kestrel{i % 40}"] + ([f"h{i // 3}"] if i < 198 else []) for i in range(200))
    assert not any(out[1000 + i].added for i in range(900))


def test_copies_are_one_context(make):
    docs = [(i, "Kestrel lives at a.b@c.org now") for i in range(9)] + [(20 + i, f"word{i}") for i in range(9)]
    assert all(not r.added for r in pii.sanitise(make(docs)).collect())
    assert pii.sanitise(make([])).count() == 0


def test_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(pii.sanitise(docs)) == sorted(((d, *brute.pii(t)[0]) for d, t in rows), key=str)
    plan = pii.digest(pii.sanitise(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hints_are_cheap_and_miss_nothing(spark, make):
    """A dot alone starts no search for addresses; what the patterns find has its hint."""
    r = random.Random(9)
    texts = ["No digits. None. At all.", "1 . 2 . 3", "v.1", *ODD, *("".join(r.choices("019.+-@a ()", k=60)) for _ in range(300))]
    rows = make(list(enumerate(texts)))
    hint = {k: f(F.col("text")) for k, f in pii.HINTS.items()}
    found = {k: F.regexp_extract_all("text", F.lit(pii.PATTERNS[k]), F.lit(0)) for k in pii.KINDS}
    assert rows.where("doc_id < 3").where(hint["ip"]).count() == 0
    for k in pii.KINDS:
        assert rows.where(F.size(found[k]) > 0).where(~hint[k]).count() == 0 and rows.where(F.size(found[k]) > 0).count() > 0


def test_many_disclosing_terms(make):
    """Words are looked up in one list of the row, not compared with its disclosing terms one by one, each time in lower case."""
    secret = [f"Secret{i}" for i in range(200)]
    rows = [(d, f"call {d} me@x.org " + " ".join(secret + [f"own{d}x{i}" for i in range(300)])) for d in range(4)] + [(9 + d, "other words only") for d in range(400)]
    df = pii.sanitise(make(rows))
    out = {x.doc_id: x.clean_text for x in df.collect()}
    assert all("Secret" not in out[d] and f"own{d}x299" in out[d] and "[EMAIL]" in out[d] for d in range(4))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(" in plan and "exists(risky" not in plan and "exists(coalesce(risky" not in plan
