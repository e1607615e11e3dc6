"""Quality rules, token counts and decontamination against plain Python."""

import numpy as np
import pandas as pd
import pytest

from specband.llm import decontaminate as winnow, quality_rules as rules, token_counts as counting
from tests.llm import brute

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_base_counts(make, odd_texts):
    out = rules.quality_rules(make(odd_texts)).toPandas()
    got = sorted((int(r.doc_id), *(int(r[c]) for c in BASE)) for _, r in out.iterrows())
    assert got == sorted((d, *map(int, brute.base_quality(t))) for d, t in odd_texts)
    assert not (out.kept & out.base_failed).any()


def test_quality_lines_and_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = rules.quality_rules(docs, keep=["lang", "n_chars"]).toPandas().merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    assert {"lang", "n_chars"} <= set(rules.quality_rules(docs, keep=["lang", "n_chars"]).select("in.*").columns)
    good = out[~out.base_failed]
    assert (good.kept == (good.quality == 1)).mean() > 0.97


def test_quality_drops_bad_lines_only(make):
    prose = "\n".join(f"Line w{i} holds a{i * 7} few b{i * 5} plain c{i * 3} words d{i}." for i in range(12))
    text = prose + "\nHome | News | Sport | Weather\nLicensed under the Example License."
    row = rules.quality_rules(make([(1, text)])).collect()[0]
    assert row.clean_text == prose and row.kept
    assert not rules.quality_rules(make([(1, "\n".join(["A | B | C | D | E | F"] * 60))])).collect()[0].kept


def test_quality_empty_table(make):
    assert rules.quality_rules(make([])).count() == 0


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(make, odd_texts, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    more = [(20, "a  b   c"), (21, " lead and trail "), (22, "tab\tnew\nline ▁mark ▁ x"), (23, "<s> </s> <unk> <0x0A>"), (24, "\n \n a \n"), (25, "  "), (26, "漢 字 é  ß")]
    rows = odd_texts + more
    out = counting.token_counts(make(rows), model).toPandas()
    want = sorted((d, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for d, t in rows)
    assert sorted(out.itertuples(index=False, name=None)) == want
    assert counting.token_counts(make([]), model).count() == 0


def test_token_counts_of_the_table(spark, sf_dir, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = counting.token_counts(docs, model).toPandas().set_index("doc_id").n_tokens
    pdf = docs.toPandas().set_index("doc_id").text
    assert (pd.Series({i: len(sp.encode(t)) for i, t in pdf.items()}) == out.reindex(pdf.index)).all()


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_decontamination(make, spark, odd_texts, block):
    base = odd_texts[3][1]
    items = [(1, base), (2, "one two three"), (3, None), (4, ""), (5, "é ß 漢字 é ß 漢字 é ß 漢字 é ß 漢字"), (None, "over THE lazy"), (7, base[20:] + " zzz"), (7, "zzz"), (8, "1 2 3 4 5 6 7 8 9 10 11 12")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = odd_texts + [(30, "0 1 2 3 4 5 6 7 8 9 10 11 12 13"), (31, "x " + base[10:90]), (32, "7 8 9 10 11 12 1 2 3 4 5 6 7 8 9 10")]
    out = winnow.decontaminate(make(docs), bench, block_windows=block, keep=["lang", "in"])
    rows = [tuple(r) for r in winnow.digest(out).collect()]
    order = lambda x: sorted(x, key=str)
    assert order(rows) == order(brute.contaminated(docs, items))
    assert {"lang", "in"} <= set(out.columns)


def test_decontamination_cuts(make, spark, odd_texts):
    base = odd_texts[3][1]
    bench = spark.createDataFrame([(1, base)], "item_id bigint, text string")
    out = winnow.decontaminate(make([(1, f"Keep é this. {base}! And ß that."), (2, "clean"), (3, None)]), bench)
    got = dict(out.select("doc_id", winnow.without_hits(out).alias("t")).collect())
    assert got == {1: "Keep é this. ! And ß that.", 2: "clean", 3: None}


def test_decontamination_empty(make, spark, odd_texts):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert winnow.digest(winnow.decontaminate(make(odd_texts), none)).where("contaminated").count() == 0
    assert winnow.decontaminate(make([]), none).count() == 0


def test_decontamination_of_the_table(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(tuple(r) for r in winnow.digest(winnow.decontaminate(docs, bench)).collect())
    assert got == sorted(brute.contaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]))
    assert any(r[-1] for r in got)


def test_decontamination_of_strangers_past_the_bit_tables(make, spark, odd_texts):
    """Tables far too small hold every bit: the exact join alone must sort the strangers out, in repeated rows and ids too."""
    r = np.random.default_rng(1)
    items = [(i, " ".join(f"w{k}" for k in r.integers(0, 50, 40))) for i in range(30)] + [(99, "w1 w2"), (98, "w3")]
    docs = [(i // 2, " ".join(f"w{k}" for k in r.integers(4, 50, 60))) for i in range(40)] + [(7, "w9 " + items[3][1] + " w9")] * 3 + odd_texts
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = winnow.decontaminate(make(docs).repartition(5), bench, block_windows=1)
    got = sorted((tuple(x) for x in winnow.digest(out).collect()), key=str)
    assert got == sorted(brute.contaminated(docs, items), key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "near" in plan and "Join" in plan


def test_bit_tables_never_miss():
    h = np.random.default_rng(2).integers(0, 1 << 64, 500, dtype=np.uint64)
    table = np.zeros(1 << 10, np.uint64)
    for cell in winnow.probes(h, 1 << 16):
        np.bitwise_or.at(table, (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
    other = np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64)
    assert winnow.held(table, h).all() and winnow.held(table, other).mean() < 0.01


@pytest.mark.parametrize("width", [1, 3, 6])
def test_winnowing_in_parts(width):
    grams = np.random.default_rng(4).integers(0, 40, 3000).astype(np.uint64) << np.uint64(40)  # many ties
    want = [i + int(np.argmin(grams[i : i + width])) for i in range(len(grams) - width + 1)]
    assert winnow.winnowed(grams, width).tolist() == want and winnow.winnowed(grams, width, bits=5).tolist() == want
