"""Word passages and byte strings that repeat, against plain Python."""

import random

import pytest

from specband.llm import substring_dedup as passages, suffix_dedup as suffixes
from tests.llm import brute


def copied(seed, n=60):
    """Documents that share passages of many lengths around the thresholds, with edits, in mixed id order."""
    r = random.Random(seed)
    vocab = [f"wörd{i}" if i % 9 == 0 else f"t{i}" for i in range(400)]
    pool = [[r.choice(vocab) for _ in range(r.randrange(8, 40))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(1, 6)):
            w += [r.choice(vocab) for _ in range(r.randrange(0, 25))]
            p = list(r.choice(pool))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "edit"
            a = r.randrange(0, 4)
            w += p[a : len(p) - r.randrange(0, 4)]
        rows.append((i * 2 + 100, r.choice([" ", "  ", "\n"]).join(w)))
    r.shuffle(rows)
    return rows + [(r.randrange(1000, 1100), rows[3][1]), (7, rows[5][1])]


def words_of(df):
    return sorted((tuple(r) for r in passages.digest(df).collect()), key=str)


def bytes_of(df):
    return sorted((tuple(r) for r in suffixes.digest(df).collect()), key=str)


@pytest.mark.parametrize("frequent, group_rows", [(16, 200_000), (2, 3)])
def test_word_passages(make, odd_texts, frequent, group_rows):
    rows = odd_texts + copied(1)
    got = words_of(passages.substring_dedup(make(rows), frequent=frequent, group_rows=group_rows))
    want = sorted(brute.word_repeats(rows), key=str)
    assert got == want and sum(r[2] > 0 for r in want) > 20


@pytest.mark.parametrize("frequent, group_rows", [(16, 200_000), (2, 3)])
def test_byte_strings(make, odd_texts, frequent, group_rows):
    rows = odd_texts + copied(2)
    got = bytes_of(suffixes.suffix_dedup(make(rows), frequent=frequent, group_rows=group_rows))
    want = sorted(brute.byte_repeats(rows), key=str)
    assert got == want and sum(r[2] > 0 for r in want) > 20


def test_outputs(make):
    text = " ".join(f"a{i}" for i in range(20))
    out = {r.doc_id: r for r in passages.substring_dedup(make([(1, text), (2, "x  " + text + "\ny")])).collect()}
    assert out[1].kept_text == text and out[2].kept_text == "x y" and [tuple(s) for s in out[2].spans] == [(1, 21)]
    out = {r.doc_id: r for r in suffixes.suffix_dedup(make([(1, text), (2, "é" + text + "é")])).collect()}
    assert bytes(out[2].kept).decode() == "éé" and [tuple(s) for s in out[2].spans] == [(2, 2 + len(text))]


def test_null_ids_and_empty(make):
    text = " ".join(f"a{i}" for i in range(40))
    got = {r.n_removed for r in passages.substring_dedup(make([(None, text), (None, text), (5, text)])).collect()}
    assert got == {0}
    assert passages.substring_dedup(make([])).count() == 0 and suffixes.suffix_dedup(make([])).count() == 0


def test_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert words_of(passages.substring_dedup(docs)) == sorted(brute.word_repeats(rows), key=str)
    assert bytes_of(suffixes.suffix_dedup(docs)) == sorted(brute.byte_repeats(rows), key=str)
