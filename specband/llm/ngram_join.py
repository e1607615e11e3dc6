"""N-gram Jaccard join with prefix trees.

Every document is its set of distinct word n-grams (64-bit hashes).  All sets are ordered by one global order: n-grams of
one set first, then those of several sets from rare to common (by hash within a power of two), then very frequent ones.  Two sets with Jaccard similarity of at
least ``t`` share an n-gram among the first ``n - ceil(t * n) + 1`` of either (prefix filter), and n-grams of one set
can be left out of the comparison since they never meet; so only sets with a shared n-gram in their prefix go on.

1. One scan turns texts into n-gram hashes and sends them, as blobs, to partitions by hash (map-side: equal sets of a
   slice once, n-grams that are frequent in a slice as one entry).  The partition tells which n-grams several sets hold.
2. Per set, the shared n-grams of its prefix go as blobs to partitions by hash.  Sets that share one are tied to the smallest of them; the
   components of these ties bound who can match whom, without listing pairs.
3. Sets of a component meet in groups of at most ``group_sets`` sets and 32 MB (a larger component is cut into blocks, and every pair of
   blocks is a group), where each set is probed against a trie of the sets before it: shared beginnings are counted
   once, and a subtree is left when its remaining n-grams cannot reach the overlap, or when all of it already belongs to
   the probe's class.  In a large group, where a walk would meet most of the trie, classes are first joined by what the n-grams
   that many sets hold tell as bits; only sets that may have a link out of their class then walk.  Every link between two classes
   is found, so classes are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specband.functions.scale import cut
from specband.llm.common import (BYTE_CODE, LOWER, SPACE, Powers, Rolling, binary, buffers, cut_runs, id_text, joined, mix, owners, partitions, slices, within,
                                 word_spans)
from specband.operators.objects import graph_components

PERCENT = 75
FREQUENT = 16  # sets of one slice that make an n-gram frequent
GROUP_SETS = 4000
GROUP_BYTES = 32 << 20
LARGE, COMMON = 64, 32  # sets of a group whose classes are joined by bits first; an n-gram is a bit if one in so many sets holds it
ROW_TOKENS, HELD_TOKENS = 2048, 1 << 20  # n-grams of a blob row aimed at, and those a scanning task holds for it at most
TOKENS, FLAT, DOC = 0, 1, 2  # kinds of rows of the exchanges


def shingles(body: np.ndarray, offsets: np.ndarray, n: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, and their offsets; a shorter text is one n-gram of all its words."""
    low = LOWER[body]
    starts, ends, words = word_spans(low, offsets, ~SPACE)
    roll, own, sizes = Rolling(Rolling(BYTE_CODE[low], powers).raw(starts, ends), powers), owners(words), np.diff(words)
    full = np.flatnonzero(within(words, n, max(0, len(starts))))
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    tokens = np.r_[roll.raw(full, full + n), roll.raw(words[short], words[short + 1])]
    who = np.r_[own[full], short]
    order = np.lexsort((tokens, who))
    tokens, who = tokens[order], who[order]
    if len(tokens):
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (who[1:] != who[:-1])]
        tokens, who = tokens[new], who[new]
    return tokens, np.searchsorted(who, np.arange(len(offsets)))


def signatures(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 63-bit number per set; equal sets, equal numbers; 0 for the empty set."""
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(tokens), dtype=np.uint64)]
    size = np.diff(at)
    sig = mix(total[at[1:]] - total[at[:-1]] + mix(size.astype(np.uint64))) >> np.uint64(1)
    return np.where(size > 0, np.maximum(sig, 1), 0).astype(np.int64)


def blob_rows(part: np.ndarray, kind: int, sigs: np.ndarray, sizes: np.ndarray, who: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
    """Rows (part, kind, sigs, sizes, counts, tokens): the tokens of every partition, grouped by their set."""
    order = np.lexsort((who, part))
    part, who, tokens = part[order], who[order], tokens[order]
    heads = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (who[1:] != who[:-1])]) if len(part) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[heads, len(part)]).astype(np.int32)
    rows = cut_runs(part[heads])
    first = heads[rows[:-1]]
    cuts = np.r_[first, len(part)] if len(first) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(part[first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int32)), binary(sigs[who[heads]], rows), binary(sizes[who[heads]].astype(np.int32), rows),
         binary(counts, rows), binary(tokens, cuts)], names=["part", "kind", "sigs", "sizes", "counts", "tokens"])


BLOBS = "part int, kind int, sigs binary, sizes binary, counts binary, tokens binary"


class Outbox:
    """Rows of several slices, held until a partition gets a blob worth a row: else rows grow with slices times partitions."""

    def __init__(self, parts: int) -> None:
        self.limit, self.rows, self.held = min(parts * ROW_TOKENS, HELD_TOKENS), {}, 0

    def put(self, part: np.ndarray, kind: int, sigs: np.ndarray, sizes: np.ndarray, who: np.ndarray, tokens: np.ndarray) -> None:
        if len(part):
            self.rows.setdefault(kind, []).append((part, sigs, sizes, who, tokens))
            self.held += len(part)

    def full(self) -> bool:
        return self.held >= self.limit

    def out(self) -> Iterator[pa.RecordBatch]:
        for kind, rows in self.rows.items():
            first = np.cumsum([0, *(len(r[1]) for r in rows)])
            part, sigs, sizes, tokens = (np.concatenate([r[k] for r in rows]) for k in (0, 1, 2, 4))
            yield blob_rows(part, kind, sigs, sizes, np.concatenate([r[3] + f for r, f in zip(rows, first)]), tokens)
        self.rows, self.held = {}, 0


def scan(docs: DataFrame, n: int, parts: int, frequent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, sent, box = Powers(), set(), Outbox(parts)
        for batch in batches:
            body, offsets = buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                tokens, at = shingles(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n, powers)
                sigs, sizes = signatures(tokens, at), np.diff(at)
                m = j - i
                # every document with its set's number, to a partition by that number
                home = (sigs % parts).astype(np.int32)
                box.put(home, DOC, sigs, sizes, np.arange(m), ids[i:j].astype(np.int64).view(np.uint64))
                fresh = np.zeros(m, bool)
                for d, s in enumerate(sigs.tolist()):
                    if s and s not in sent:
                        sent.add(s)
                        fresh[d] = True
                use = np.repeat(fresh, sizes)
                tokens, who = tokens[use], np.repeat(np.arange(m), sizes)[use]
                part = (tokens % np.uint64(parts)).astype(np.int32)
                names, inverse, times = np.unique(tokens, return_inverse=True, return_counts=True)
                often = times >= frequent
                flat = often[inverse]
                box.put(part[~flat], TOKENS, sigs, sizes, who[~flat], tokens[~flat])
                if flat.any():  # one entry for the partition; each set keeps its own list
                    hot = names[often]
                    box.put((hot % np.uint64(parts)).astype(np.int32), TOKENS, np.array([-1]), np.array([0]), np.zeros(len(hot), np.int64), hot)
                    box.put((sigs[who[flat]] % parts).astype(np.int32), FLAT, sigs, sizes, who[flat], tokens[flat])
                if box.full():
                    yield from box.out()
        yield from box.out()

    return docs.mapInArrow(run, BLOBS)


def shared(blobs: DataFrame, parts: int) -> DataFrame:
    """Of every set, the n-grams that other sets hold too, again as blobs to partitions by set; other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, sizes, tokens, counts = [], [], [], []
        for batch in batches:
            mine = batch.filter(pa.compute.equal(batch.column(1), TOKENS))
            rest = batch.filter(pa.compute.not_equal(batch.column(1), TOKENS))
            if rest.num_rows:
                yield rest
            for name, dtype, into in (("sigs", np.int64, sigs), ("sizes", np.int32, sizes), ("counts", np.int32, counts), ("tokens", np.uint64, tokens)):
                into.append(joined(mine.column(mine.schema.get_field_index(name)), dtype).copy())
        if not tokens:
            return
        sigs, sizes, tokens, counts = (np.concatenate(x) for x in (sigs, sizes, tokens, counts))
        who = np.repeat(np.arange(len(sigs), dtype=np.int32), counts)
        order = np.argsort(tokens, kind="stable")
        t, s = tokens[order], sigs[who[order]]
        runs = cut_runs(t)
        if len(runs) < 2:
            return
        many = np.minimum.reduceat(s, runs[:-1]) != np.maximum.reduceat(s, runs[:-1])
        hot = np.minimum.reduceat(s, runs[:-1]) == -1
        length = np.diff(runs)
        # the order of n-grams: the number of sets by powers of two, then the hash; told in the n-gram itself
        rank = np.minimum(np.log2(np.maximum(length, 1)).astype(np.uint64), np.uint64(15))
        tokens[order] = np.where(np.repeat(hot, length), t, (np.repeat(rank, length) << np.uint64(60)) | (t >> np.uint64(4)))
        pick = order[np.repeat(many & ~hot, length)]
        for kind, at in ((TOKENS, pick), (FLAT, order[np.repeat(hot & many, length) & (s >= 0)])):
            for i in range(0, len(at), 1 << 20):
                part = at[i : i + (1 << 20)]
                yield blob_rows((sigs[who[part]] % parts).astype(np.int32), kind, sigs, sizes, who[part], tokens[part])

    return blobs.repartitionById(parts, "part").mapInArrow(run, BLOBS)


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Fewest n-grams that a set of ``n`` shares with any set as similar as asked for."""
    return -(-n * percent // 100)


def candidates(blobs: DataFrame, parts: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents ``doc_id, sig, n``; sets ``sig, n, prefix, tokens`` with a shared n-gram in the prefix.

    ``tokens`` are the shared n-grams in global order; the first ``prefix`` of them lie in the prefix of the set.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n, c = (joined(batch.column(k), t) for k, t in ((2, np.int64), (3, np.int32), (4, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(joined(batch.column(5), np.int64)), pa.array(np.repeat(sig, c)), pa.array(np.repeat(n, c).astype(np.int64))],
                                             names=["doc_id", "sig", "n"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], [], [], []]
        for batch in batches:
            for k, t in ((2, np.int64), (3, np.int32), (4, np.int32), (5, np.uint64)):
                cols[k - 2].append(joined(batch.column(k), t).copy())
            sets = np.frombuffer(batch.column(4).buffers()[1], np.int32)[batch.column(4).offset : batch.column(4).offset + batch.num_rows + 1]
            cols[4].append(np.repeat(batch.column(1).to_numpy(), np.diff(sets) // 4))
        if not cols[0]:
            return
        sigs, sizes, counts, tokens, kind = (np.concatenate(x) for x in cols)
        s, flat, n = np.repeat(sigs, counts), np.repeat(kind, counts), np.repeat(sizes, counts)
        order = np.lexsort((tokens, flat, s))
        s, tokens, flat, n = s[order], tokens[order], flat[order], n[order]
        once = np.r_[True, (s[1:] != s[:-1]) | (tokens[1:] != tokens[:-1])]  # several slices may have sent one set
        s, tokens, flat, n = s[once], tokens[once], flat[once], n[once]
        runs = cut_runs(s)
        size, have = n[runs[:-1]].astype(np.int64), np.diff(runs)
        prefix = size - need(size, percent) + 1 - (size - have)  # n-grams of no other set come first
        live = np.flatnonzero(prefix > 0)
        keep = np.repeat(prefix > 0, have)
        at = np.r_[0, np.cumsum(have[live])]
        for i in range(0, len(live), 2000):
            j = min(i + 2000, len(live))
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[runs[live[i:j]]]), pa.array(size[live[i:j]]), pa.array(prefix[live[i:j]]), binary(tokens[keep][at[i] : at[j]], at[i : j + 1] - at[i])],
                names=["sig", "n", "prefix", "tokens"])

    docs = blobs.where(F.col("kind") == DOC).mapInArrow(unpack, "doc_id bigint, sig bigint, n bigint")
    sets = blobs.where(F.col("kind") != DOC).repartitionById(parts, "part").mapInArrow(collect, "sig bigint, n bigint, prefix bigint, tokens binary")
    return docs, sets


class Node:
    """Trie edge: a run of tokens, then children or a set that ends here."""

    __slots__ = ("edge", "children", "ends", "small", "large", "deep", "low", "any", "one")

    def __init__(self, edge: np.ndarray) -> None:
        self.edge, self.children, self.ends = edge, {}, []
        self.small, self.large, self.deep = 1 << 60, 0, 0  # set sizes below; most tokens after this edge
        self.any, self.one = -1, True  # a set below; whether all sets below are of one class


class PrefixTree:
    """Sets of one group, inserted by size; answers which of them a probe links to."""

    def __init__(self, percent: int, n_tokens: int, every: bool) -> None:
        self.percent, self.every, self.root = percent, every, Node(np.zeros(0, np.int64))
        self.mask = np.zeros(n_tokens, bool)
        self.parent: list[int] = []
        self.block: list[int] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def probe(self, me: int, tokens: np.ndarray, n: int, sizes: np.ndarray, cross: bool) -> list[tuple[int, int]]:
        """Sets that link to set ``me`` and share ``(set, overlap)``; within a class one is enough unless ``every``."""
        self.mask[tokens] = True
        found, stack = [], [(self.root, 0, len(tokens))]
        while stack:
            node, have, left = stack.pop()
            if not self.every and node.one and node.any >= 0 and self.find(node.any) == self.find(me):
                continue
            if node.large * 100 < n * self.percent:  # all sets below are too small
                continue
            edge = node.edge
            if len(edge):
                have += int(self.mask[edge].sum())
                left = len(tokens) - int(np.searchsorted(tokens, edge[-1], side="right"))
            floor = max(node.small, -(-n * self.percent // 100))
            if (have + min(left, node.deep)) * (100 + self.percent) < self.percent * (n + floor):
                continue
            for other in node.ends:
                if have * (100 + self.percent) >= self.percent * (n + int(sizes[other])) and not (cross and self.block[other] == self.block[me]):
                    if self.every or self.find(other) != self.find(me):
                        found.append((other, have))
                        self.parent[self.find(other)] = self.find(me)
            # likeliest subtree last on the stack, so first in turn
            kids = sorted(node.children.values(), key=lambda c: self.mask[c.edge[0]])
            stack += [(c, have, left) for c in kids]
        self.mask[tokens] = False
        return found

    def insert(self, me: int, tokens: np.ndarray, n: int) -> None:
        node, path, at = self.root, [self.root], 0
        while at < len(tokens):
            child = node.children.get(int(tokens[at]))
            if child is None:
                child = Node(tokens[at:])
                node.children[int(tokens[at])] = child
                path.append(child)
                node = child
                break
            m = min(len(child.edge), len(tokens) - at)
            differ = np.flatnonzero(child.edge[:m] != tokens[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.edge):  # split the edge
                top = Node(child.edge[:same])
                top.small, top.large, top.any, top.one = child.small, child.large, child.any, child.one
                top.deep = child.deep + len(child.edge) - same
                child.edge = child.edge[same:]
                top.children[int(child.edge[0])] = child
                node.children[int(tokens[at])] = top
                child = top
            path.append(child)
            node, at = child, at + same
        node.ends.append(me)
        after = 0
        for step in reversed(path):
            step.small, step.large, step.deep = min(step.small, n), max(step.large, n), max(step.deep, after)
            after += len(step.edge)
            step.any = me
            mine = self.find(me)
            step.one = all(c.one and self.find(c.any) == mine for c in step.children.values()) and all(self.find(e) == mine for e in step.ends)


def bit_links(local: np.ndarray, at: np.ndarray, sizes: np.ndarray, block: np.ndarray, percent: int, cross: bool) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Links that the n-grams held by many sets settle, the classes they make, and the sets that may have a link out of their class.

    Sets are sorted by size.  Many sets are a ``1 / COMMON``-th of the group, so bits take no more than half of the n-grams' space; of
    the n-grams that fewer, but not only one, hold, two sets share at most those of the set that has less of them.
    """
    m = len(sizes)
    held = np.bincount(local)
    common = held >= max(2, m / COMMON)
    who, bit = owners(at), np.cumsum(common) - 1
    use = common[local]
    words = int(common.sum()) // 64 + 1
    bits = np.zeros(m * words, np.uint64)
    cell, shift = who[use] * words + bit[local[use]] // 64, (bit[local[use]] % 64).astype(np.uint64)
    np.bitwise_or.at(bits, cell, np.uint64(1) << shift)
    bits = bits.reshape(m, words)
    rare = np.bincount(who[(held[local] > 1) & ~use], minlength=m)
    label, open_, links = np.arange(m), np.zeros(m, bool), []
    first = np.searchsorted(sizes * 100, sizes * percent)  # smaller ones cannot be similar
    for i in range(m):
        j = first[i]
        both = np.bitwise_count(bits[j:i] & bits[i]).sum(axis=1, dtype=np.int64)
        floor = percent * (sizes[j:i] + sizes[i])
        near = (both + np.minimum(rare[j:i], rare[i])) * (100 + percent) >= floor
        if cross:
            near &= block[j:i] != block[i]
        other = np.flatnonzero(near)
        other = other[label[j + other] != label[i]]
        sure = j + other[both[other] * (100 + percent) >= floor[other]]
        if len(sure):
            classes, one = np.unique(label[sure], return_index=True)
            links += [(i, int(x)) for x in sure[one]]
            label[np.isin(label, classes)] = label[i]
            other = other[label[j + other] != label[i]]
        if len(other):
            open_[i] = open_[j + other] = True
    return links, label, open_


def tree_join(sig: np.ndarray, n: np.ndarray, block: np.ndarray, lists: list[np.ndarray], percent: int, every: bool, cross: bool) -> list[tuple[int, int, int, int]]:
    """Links among the sets of a group: all of them, or enough to join every class.

    In a large group all links need not be known, so most classes are joined by bits first, and the tree takes the sets that may
    have further links, as members of these classes.
    """
    order = np.lexsort((sig, n))
    sig, sizes, block, lists = sig[order], n[order], block[order], [lists[k] for k in order]
    # shared n-grams from rare to common; where frequent ones fall does not matter inside a group, as long as it is one order
    names, local = np.unique(np.concatenate(lists), return_inverse=True)
    at = np.r_[0, np.cumsum([len(x) for x in lists])]
    tree, out = PrefixTree(percent, len(names), every), []
    tree.block = block.tolist()
    tree.parent = list(range(len(lists)))
    todo = range(len(lists))
    if not every and len(lists) >= LARGE:
        links, label, open_ = bit_links(local, at, sizes, block, percent, cross)
        for i, j in links:
            overlap = len(np.intersect1d(lists[i], lists[j], assume_unique=True))
            out.append((sig[i], sig[j], overlap, int(sizes[i] + sizes[j] - overlap)))
        tree.parent, todo = label.tolist(), np.flatnonzero(open_).tolist()
    for i in todo:
        tokens = np.sort(local[at[i] : at[i + 1]])
        for other, overlap in tree.probe(i, tokens, int(sizes[i]), sizes, cross):
            out.append((sig[i], sig[other], overlap, int(sizes[i] + sizes[other] - overlap)))
        tree.insert(i, tokens, int(sizes[i]))
    return out


def tied(sets: DataFrame, parts: int) -> DataFrame:
    """Ties ``u, v``: every set with the smallest one that shares an n-gram of both prefixes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n, prefix, at = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            ends = np.frombuffer(at.buffers()[1], np.int32)[at.offset : at.offset + len(at) + 1].astype(np.int64) // 8
            ends -= ends[0]
            take = np.repeat(ends[:-1] - np.r_[0, np.cumsum(prefix)[:-1]], prefix) + np.arange(prefix.sum())
            tokens = joined(at, np.uint64)[take]
            yield blob_rows((tokens % np.uint64(parts)).astype(np.int32), TOKENS, sig, n, np.repeat(np.arange(len(sig)), prefix), tokens)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, tokens = [], []
        for batch in batches:
            sigs.append(np.repeat(joined(batch.column(2), np.int64), joined(batch.column(4), np.int32)))
            tokens.append(joined(batch.column(5), np.uint64).copy())
        if not tokens:
            return
        sigs, tokens = np.concatenate(sigs), np.concatenate(tokens)
        order = np.argsort(tokens, kind="stable")
        v, runs = sigs[order], cut_runs(tokens[order])
        if len(runs) < 2:
            return
        u = np.repeat(np.minimum.reduceat(v, runs[:-1]), np.diff(runs))
        u, v = u[u != v], v[u != v]
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])][: len(u)]
        yield pa.RecordBatch.from_arrays([pa.array(u[new]), pa.array(v[new])], names=["u", "v"])

    return sets.mapInArrow(send, BLOBS).repartitionById(parts, "part").mapInArrow(tie, "u bigint, v bigint").distinct()


def set_links(sets: DataFrame, percent: int, group_sets: int = GROUP_SETS, every: bool = False) -> DataFrame:
    """Links ``u, v, overlap, together`` between distinct sets."""
    ties = cut(tied(sets, partitions(sets)))
    if ties.isEmpty():
        return sets.sparkSession.createDataFrame([], "u bigint, v bigint, overlap bigint, together bigint")
    root = graph_components(ties).select(F.col("node").alias("sig"), "root")
    members = sets.join(root, "sig")
    size = members.groupBy("root").agg(F.count("*").alias("m"), F.sum(F.octet_length("tokens")).alias("bytes"))
    b = F.ceil(F.greatest(F.col("m") / group_sets, F.col("bytes") / GROUP_BYTES)).cast("int")
    placed = members.join(size, "root").withColumn("b", b).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("b")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    placed = placed.select("root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "sig", "n", "tokens")

    def group(rows: list[pa.RecordBatch]) -> list[tuple[int, int, int, int]]:
        """The rows of one group, which may lie in several batches."""
        i, j = rows[0].column(1)[0].as_py(), rows[0].column(2)[0].as_py()
        block, sig, n = (np.concatenate([r.column(k).to_numpy() for r in rows]) for k in (3, 4, 5))
        return tree_join(sig, n, block, [np.frombuffer(x.as_buffer(), np.uint64) for r in rows for x in r.column(6)], percent, every, i != j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for batch in batches:
            keys, links = np.stack([batch.column(k).to_numpy() for k in range(3)]), []
            heads = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(heads[:-1], heads[1:]):
                if rows and last != tuple(keys[:, a]):
                    links += group(rows)
                    rows = []
                rows.append(batch.slice(a, b - a))
                last = tuple(keys[:, a])
            yield listed(links)
        if rows:
            yield listed(group(rows))

    def listed(links: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        cols = np.array(links, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(cols[:, k]) for k in range(4)], names=["u", "v", "overlap", "together"])

    keys = ["root", "i", "j"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u bigint, v bigint, overlap bigint, together bigint")


def ngram_join(docs: DataFrame, n: int = 5, percent: int = PERCENT, frequent: int = FREQUENT, group_sets: int = GROUP_SETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for every row.

    ``class_id`` is the smallest id with the same set; ``component_id`` the smallest id reachable by links between sets
    (100 * intersection >= percent * union), over any number of steps.  Null and empty texts have no n-grams and are alone.
    Repeated rows and ids are copies of each other where their texts agree.  A null id never names a component: such a row
    gets its component's smallest id, or null.  A very long text is a slice of its own and one set, as large as its n-grams; an empty table gives no rows.
    """
    parts = partitions(docs)
    blobs = cut(shared(scan(id_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), n, parts, frequent), parts))
    rows, sets = candidates(blobs, parts, percent)
    links = cut(set_links(cut(sets), percent, group_sets).select("u", "v"))
    known = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    full = rows.where("n > 0")
    classes = full.groupBy("sig").agg(F.min(known).alias("class_id"))
    if not links.isEmpty():
        root = graph_components(links).select(F.col("node").alias("sig"), "root")
        classes = cut(classes.join(root, "sig", "left"))
        low = classes.where("root IS NOT NULL").groupBy("root").agg(F.min("class_id").alias("low"))
        classes = classes.join(low, "root", "left").select("sig", "class_id", F.coalesce("low", "class_id").alias("component_id"))
    else:
        classes = classes.withColumn("component_id", F.col("class_id"))
    alone = rows.where("n = 0").select(known.alias("doc_id"), F.col("n").alias("n_shingles"), known.alias("class_id"), known.alias("component_id"))
    return full.join(classes, "sig").select(known.alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", "component_id").union(alone)


NO_ID = -(1 << 63)  # stands for a null id inside the exchanges


def similar_sets(docs: DataFrame, n: int = 5, percent: int = PERCENT, group_sets: int = GROUP_SETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every pair of linked distinct sets by their class ids, with overlap and union sizes: ``a < b``, no copies expanded."""
    parts = partitions(docs)
    blobs = cut(shared(scan(id_text(docs, id_col, text_col).where("doc_id IS NOT NULL"), n, parts, FREQUENT), parts))
    rows, sets = candidates(blobs, parts, percent)
    ids = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("id"))
    links = set_links(cut(sets), percent, group_sets, every=True)
    out = links.join(ids.select(F.col("sig").alias("u"), F.col("id").alias("x")), "u").join(ids.select(F.col("sig").alias("v"), F.col("id").alias("y")), "v")
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap", "together")
