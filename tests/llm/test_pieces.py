"""Merges against the library, Viterbi against a plain search over the same scores, and exact round trips."""

import hashlib

import pytest

from specband.llm import pieces


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain(path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    longest, floor = max(map(len, table)), min(s for s, _ in table.values()) - 10
    as_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}

    def encode(text):
        if not text:
            return []
        t = "▁" + text.replace(" ", "▁")
        best = [(0.0, None)] + [None] * len(t)
        for e in range(1, len(t) + 1):
            choice = (best[e - 1][0] + floor, (e - 1, None))
            for n in range(1, min(longest, e) + 1):
                if t[e - n : e] in table:
                    s, i = table[t[e - n : e]]
                    s += best[e - n][0]
                    if s > choice[0] or s == choice[0] and n > 1:
                        choice = (s, (e - n, i))
            best[e] = choice
        out, e = [], len(t)
        while e:
            b, i = best[e][1]
            out.append([i] if i is not None else [as_byte[c] for c in t[b:e].encode()])
            e = b
        return [i for part in reversed(out) for i in part]

    return encode


MORE = [(30, "a  b   c"), (31, " lead and trail "), (32, "tab\tnew\nline"), (33, "<s> </s> <unk> <0x0A>"), (34, "漢字かな交じり文 ☃ 🙂🙂"), (35, "x" * 300 + "漢" * 100 + "internationalization" * 30), (36, "   "), (37, "\x00\x7f")]


def test_segmentation(make, odd_texts, path, plain):
    rows = [r for r in odd_texts if r[0] != 14] + MORE
    got = {r.doc_id: list(r.ids) for r in pieces.encode(make(rows), path, "viterbi").collect()}
    for d, t in rows:
        assert got[d] == plain(t or ""), d


def test_merges_equal_the_library(make, odd_texts, path):
    import sentencepiece

    assert pieces.model_type(path) == pieces.BPE
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = odd_texts + MORE + [(40, "mark ▁ here"), (41, "aaaaaaaaaaaaaaaa bbbbbbb  thethethe")]
    got = {r.doc_id: list(r.ids) for r in pieces.encode(make(rows), path).collect()}
    for d, t in rows:
        assert got[d] == sp.encode(t or ""), d


def test_round_trip(make, odd_texts, path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = odd_texts + MORE + [(None, "no id"), (40, "mark ▁ here")]
    enc = pieces.encode(make(rows), path)
    back = {r.doc_id: r.text for r in pieces.decode(enc, path).collect()}
    for d, t in rows:
        assert back[d] == (t or "").replace("▁", " ")
    for r in enc.collect():
        assert sp.decode(list(r.ids)) == back[r.doc_id]
    for r in pieces.round_trip(make(rows), path).collect():
        assert r.exact == (r.doc_id != 40) and r.decoded_sha256 == hashlib.sha256(back[r.doc_id].encode()).hexdigest()
    assert pieces.encode(make([]), path).count() == 0


def test_odd_ids(spark, path):
    df = spark.createDataFrame([(1, [65, None, 99999999, -5, 0, 1]), (2, None), (3, [3 + 0xE6])], "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.text for r in pieces.decode(df, path).collect()}
    assert got[2] == "" and got[3] == "�"


def test_the_table(spark, sf_dir, path, plain):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    out = pieces.round_trip(docs, path).collect()
    assert len(out) == len(text) and all(r.exact for r in out)
    assert all(list(r.ids) == sp.encode(text[r.doc_id]) for r in out)
    for r in pieces.encode(docs, path, "viterbi").collect():
        if len(text[r.doc_id]) < 3000:
            assert list(r.ids) == plain(text[r.doc_id])
