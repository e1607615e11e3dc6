"""Source divergence against SQL and plain Python."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from specband.llm import source_divergence as divergence, sql


def plain(rows, min_docs, top=50):
    docs = [((t or ""), lang or "", source or "") for t, lang, source in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for t, _, _ in docs]
    out = []
    for lang in {x for _, x, _ in docs}:
        mine = [(w, s) for w, (_, x, s) in zip(terms, docs) if x == lang]
        kept = sorted(t for t in {t for w, _ in mine for t in w} if sum(t in w for w, _ in mine) >= min_docs)
        count = {s: {t: sum(w.count(t) for w, y in mine if y == s) for t in kept} for s in {s for _, s in mine}}
        whole = {t: sum(c[t] for c in count.values()) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        share, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in count:
            pairs = [("pair", h, sum(abs(share[s][t] - share[h][t]) for t in kept)) for h in count if h != s]
            over = [("term", t, share[s][t] - q[t]) for t in kept if count[s][t] > 0 and share[s][t] > q[t]]
            for part in (pairs, over):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, k + 1) for k, x in enumerate(part[: top if part is over else None])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocab = [f"{a}{b}" for a in ("né", "bo", "Ka", "漢", "x-y", "zu", "ti") for b in ("ra", "lo", "N", "é", "Ä")]
    text = lambda k: " ".join(r.choice(vocab[k:k + 20]) + r.choice([" ", ", ", "1", "\n"]) for _ in range(r.randrange(60)))
    out = [(text(3 * k % 15), lang, f"s{k}") for lang in ("en", "de") for k in range(6) for _ in range(8)]
    out += [(None, "en", "bare"), ("", None, None), ("12 34", None, "n"), ("alone word", "xx", None), (None, "yy", "a"), (" ", "yy", "b"), ("word", "yy", "")]
    return out + out[:5] + [("Word, " * 30000, "en", "s0")]


def collect(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [3, 4096])
def test_against_plain_python(spark, rows, block):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("x"), "n": F.lit(1), "block": F.lit(2), "value": F.lit(None).cast("int")})
    got = collect(divergence.source_divergence(docs, min_docs=4, block=block))
    assert got == plain(rows, 4)
    assert any(r[2] == "pair" and r[4] == 0 for r in got) and any(r[2] == "term" for r in got)


def test_statement_on_odd_rows(spark, rows, tmp_path):
    many = rows * 8
    docs = spark.createDataFrame(many, "text string, lang string, source string")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert collect(divergence.source_divergence(docs)) == sorted(con.execute(sql.DIVERGENCE).fetchall()) == plain(many, 30)


def test_empty_and_other_names(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(none).count() == 0
    docs = spark.createDataFrame([("a b", "en", "x"), ("a c", "en", "y")], "body string, tongue string, site string")
    got = collect(divergence.source_divergence(docs, min_docs=1, text_col="body", lang_col="tongue", source_col="site"))
    assert got == plain([("a b", "en", "x"), ("a c", "en", "y")], 1)


def test_run_differences_equal_dense_ones():
    r = np.random.default_rng(2)
    columns = r.integers(0, 3, (5, 40)).cumsum(1) // 7
    weight = r.integers(1, 9, 40)
    g, h, value = divergence.run_differences([divergence.runs_of(c) for c in columns], weight.cumsum())
    assert [int((np.abs(columns[a] - columns[b]) * weight).sum()) for a, b in zip(g, h)] == value.tolist() and len(g) == 10


def test_shares_beyond_64_bits():
    big = np.array([0, 5, 10**13, 9 * 10**17])
    assert divergence.exact_share(big, 10**18, 10**6).tolist() == [1 + 10**9 * (int(c) + 5) // (10**18 + 5 * 10**6) for c in big]
