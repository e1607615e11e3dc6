"""Tokenizer alignment against a plain merge of the libraries' whole-text output."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from specband.llm import alignment


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows, paths):
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    of_byte = {chr(256 + k): x for k, x in enumerate(x for x in range(256) if not (0x21 <= x <= 0x7E or 0xA1 <= x <= 0xAC or 0xAE <= x <= 0xFF))}
    a_bytes = lambda i: bytes(of_byte.get(c, ord(c) if c not in of_byte else 0) for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for d, t in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        p, q = [a_bytes(i) for i in x], [b_bytes(i) for i in y]
        if not t or b"".join(p) != (" " + t).encode() or b"".join(q) != (" " + t).encode():
            docs.append((d, [], [], [], []))
            continue
        ends = lambda parts: np.cumsum([len(z) for z in parts]).tolist()
        ea, eb = ends(p), ends(q)
        both, links, groups, u, v = set(ea) & set(eb), [], [], 0, 0
        for e in sorted(both):
            i, j = ea.index(e), eb.index(e)
            groups.append(",".join(map(str, x[u:i + 1])) + "|" + ",".join(map(str, y[v:j + 1])))
            links.append((x[i], y[j]))
            u, v = i + 1, j + 1
        docs.append((d, x, y, links, groups))
    count = Counter(z for *_, links, _ in docs for z in links)
    best = {}
    for (i, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return sorted((d, len(x), len(y), len(g), len(z), sum(count[k] == best[k[1]] for k in z), sum(count[k] for k in z),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, x, y, z, g in docs)


def collect(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(tuple(r) for r in df.collect())


def test_odd_texts_equal_a_plain_merge(make, odd_texts, paths):
    more = [(30, "a  b   c"), (31, " lead and trail "), (32, "tab\tnew\nline x"), (33, "has ▁ a mark"), (34, "<|endoftext|> <s> </s> <unk> <0x0A> it's we'll"), (35, "\n \n a \n"), (36, "  "), (37, "漢字" * 900),
            (38, "a\n b  c  d\x1c e"), (39, "zero\x00byte ﬁ ™"), (40, "🙂👩‍👩‍👧 x🙂 y"), (41, "a▁b"), (42, "x y" + "z" * 5000), (43, "1234567 89,10 3.14")]
    rows = odd_texts + more
    out = collect(alignment.tokenizer_alignment(make(rows), *paths))
    assert out == plain(rows, paths)
    zero = {r[0] for r in out if r[1] == 0}
    assert {1, 2, 33, 41} <= zero and all(r[-1] == "" for r in out if r[1] == 0)


def test_the_table_equals_a_plain_merge(spark, sf_dir, paths):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert collect(alignment.tokenizer_alignment(docs.repartition(5), *paths)) == plain([(r.doc_id, r.text) for r in docs.collect()], paths)


def test_empty_table_and_null_id(make, paths):
    assert alignment.tokenizer_alignment(make([]), *paths).count() == 0
    out = alignment.tokenizer_alignment(make([(None, "a b"), (None, None)]), *paths).collect()
    assert [r.doc_id for r in out] == [None, None] and sorted(r.n_a for r in out) == [0, 2]


def test_lockstep_and_lanes():
    r = np.random.default_rng(4)
    sets = [(np.unique(np.r_[r.integers(1, n, n // 3), n]), np.unique(np.r_[r.integers(1, n, n // 4), n])) for n in r.integers(5, 400, 30)]
    shift = np.r_[0, np.cumsum([x[-1] for x, _ in sets])]
    a_end, b_end = (np.concatenate([s[k] + o for s, o in zip(sets, shift)]) for k in (0, 1))
    for step in (7, 10**6):
        marks = np.unique(np.r_[shift, np.arange(0, shift[-1], step)])
        i, j = alignment.lockstep(a_end, alignment.lanes(a_end, marks), b_end, alignment.lanes(b_end, marks))
        assert a_end[i].tolist() == b_end[j].tolist() == np.intersect1d(a_end, b_end).tolist()


def test_small_cache_changes_nothing(paths, odd_texts):
    texts = [t or "" for _, t in odd_texts]
    one, many = alignment.Parts(alignment.Pair(*paths)), alignment.Parts(alignment.Pair(*paths))
    whole = alignment.aligned(texts, one)
    for k, t in enumerate(texts):
        many.clear()
        counts, digest, pairs, at = alignment.aligned([t], many)
        assert counts[0].tolist() == whole[0][k].tolist() and digest[0] == whole[1][k] and pairs.tolist() == whole[2][whole[3][k]:whole[3][k + 1]].tolist()
