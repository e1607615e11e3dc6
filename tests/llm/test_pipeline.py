"""The pipeline's stages against plain Python, on texts made for each of them."""

import random

import pytest

import corpus_pipeline
from specband.llm import pieces
from tests.llm import brute


@pytest.fixture(scope="module")
def corpus(make, spark):
    r = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    prose = lambda n: ".\n".join(" ".join(r.choice(vocab) for _ in range(12)) for _ in range(n // 12)) + "."
    items = [" ".join(r.choice(vocab) for _ in range(30)) for _ in range(4)]
    rows = [(i, prose(120)) for i in range(20)]
    rows += [(100, rows[3][1]), (101, rows[3][1].replace(rows[3][1].split()[7], "changed", 1)), (102, "too short"), (103, "A | B | C | D\n" * 60), (104, None)]
    rows += [(105, prose(96) + " " + items[1] + " " + prose(96)), (106, prose(96) + " mail me@x.org or 8.8.8.8 " + prose(96)), (107, prose(120) + "\nHome | News | Sport | More"), (20, prose(120)), (20, prose(120))]
    return rows, items


def test_stages(make, spark, corpus, tmp_path):
    rows, items = corpus
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make(rows, extra=False)
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
            assert docs.where("n_chars <> length(text)").count() == 0
    text = {n: [(d.doc_id, d.text) for d in df.collect()] for n, df in seen.items() if n != "SentencePiece"}

    gone = {102, 103, 104}
    quality = [(d, t.rsplit("\n", 1)[0] if d == 107 else t) for d, t in rows if d not in gone]
    assert sorted(text["quality rules"]) == sorted(quality)

    comp = {k: c for k, _, c in brute.components([(k, t) for k, (_, t) in enumerate(quality)])}  # by row: ids may repeat
    first = {c: min(quality[k] for k in comp if comp[k] == c) for c in comp.values()}
    want = sorted(first.values())
    assert sorted(text["n-gram Jaccard join"]) == want and not {100, 101} & {d for d, _ in want} and sum(d == 20 for d, _ in want) == 2

    left = sorted(text["benchmark decontamination"])
    cut = dict(left)[105]
    assert [d for d, _ in left] == [d for d, _ in want] and items[1] not in cut and dict(want)[105].split()[0] in cut
    assert not any(r[-1] for r in brute.contaminated([(k, t) for k, (d, t) in enumerate(left) if d != 105], list(enumerate(items))))
    assert [r for r in left if r[0] != 105] == [r for r in want if r[0] != 105]

    clean = sorted(text["PII"])
    assert clean == sorted((d, t.replace("me@x.org", "[EMAIL]").replace("8.8.8.8", "[IP]") if d == 106 else t) for d, t in left)

    import public_tokenizers

    back = pieces.decode(seen["SentencePiece"], public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == clean


def test_run_over_the_table(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert kept and not [d for d in kept if labels.get(d) == 0]
    comp = {d: c for d, _, c in brute.components(docs)}
    missing = [d for d, t in docs if labels.get(d) == 1 and comp[d] == d and not brute.base_quality(t)[-1] and d not in kept]
    assert len(missing) <= 0.02 * len(docs)


def test_empty(make, spark, sf_dir):
    docs = make([], extra=False)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_rows_that_share_an_id(make, spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(3)), (3, text(4)), (3, text(4)), (4, text(3) + " more"), (5, " "), (5, " "), (None, text(1)), (6, text(5)), (6, text(5) + " end")]
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, make(rows, extra=False), "").collect()]
    six = [t for d, t in out if d == 6]
    assert len(six) == 1 and six[0] in (text(5), text(5) + " end")
    assert sorted((r for r in out if r[0] != 6), key=str) == sorted([(1, text(1)), (2, text(2)), (3, text(3)), (3, text(4)), (5, " "), (5, " "), (None, text(1))], key=str)
