"""Evaluation texts in training text: suffix arrays of training shards, binary-searched with every test suffix.

Each task sorts the suffixes of shards of about SHARD characters (whole documents) and looks up every suffix of every item by
binary search; runs of consecutive suffixes are the longest verbatim matches, with their places in item and document. Wherever matches of an
item lie close together in a document, that passage is aligned with the item; the best passage decides. Nothing is exchanged: only the items, in blocks of
bounded size, travel to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdial.functions.text import half_width

#: Characters that a match begins with (fewer for items below 32 characters), characters of a shard, characters of a block of items, matches of a shard held at once.
SEED, SHARD, ITEM_BLOCK, MATCHES = 8, 1_000_000, 8_000_000, 4_000_000
#: A passage is aligned if verbatim matches of SEED characters or more, at about the same offset, cover this part of the share looked for.
HINT = 0.5
_GAP = 3


def passage_key(c: Column) -> Column:
    """Text without layout, markup, width, case and marks: the letters and digits of every script."""
    bare = half_width(F.regexp_replace(F.regexp_replace(c, r"</?[A-Za-z][^<>]{0,80}>", ""), r"&[a-z]{2,6};", ""))
    return F.regexp_replace(F.lower(bare), r"[^\p{L}\p{M}\p{N}]+", "")


def seed_length(length: int, share: float) -> int:
    """Characters that a match with an item of this length begins with: all that the hint asks for, SEED at most."""
    return max(1, min(SEED, math.ceil(HINT * share * length)))


def _pack(codes: np.ndarray) -> np.ndarray:
    """Four characters from every place on, as one number."""
    c = np.concatenate([codes, np.zeros(SEED, codes.dtype)]).astype(np.uint64)
    n = len(codes) + SEED - 3
    return (c[:n] << np.uint64(48)) | (c[1 : n + 1] << np.uint64(32)) | (c[2 : n + 2] << np.uint64(16)) | c[3 : n + 3]


@dataclass
class Items:
    """Test items of one block, their characters and their suffixes."""

    ids: np.ndarray
    texts: list[str]
    chars: np.ndarray
    item: np.ndarray
    place: np.ndarray
    size: np.ndarray
    seed: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]], share: float = 0.5) -> Items:
        texts = [t for _, t in rows]
        chars = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        item = np.repeat(np.arange(len(texts)), np.maximum(lengths + 1, 1))[: len(chars)]
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        place = np.arange(len(chars)) - begins[item] if len(chars) else np.zeros(0, np.int64)
        seed = np.array([seed_length(n, share) if n >= SEED else n + 1 for n in lengths.tolist()], dtype=np.int64)  # shorter ones are looked for whole
        return cls(np.array([i for i, _ in rows]), texts, chars, item, place, lengths, seed)


class SuffixArray:
    """The suffixes of a shard of texts in order, to the depth of a seed (longer matches show as runs of suffixes)."""

    def __init__(self, texts: list[str]):
        chars = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        self.four, of_four = np.unique(_pack(_code(chars)), return_inverse=True)
        key = (of_four[: len(chars)].astype(np.uint64) << np.uint64(32)) | of_four[4 : len(chars) + 4].astype(np.uint64)
        self.order = np.argsort(key)
        self.key = key[self.order]

    def ranges(self, codes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By binary search: where in the order the suffixes stand that begin with the same depth characters, for every test suffix."""
        open_ = np.uint64(0xFFFF_FFFF_FFFF_FFFF) >> (np.uint64(16) * np.arange(5, dtype=np.uint64).clip(max=3))
        open_[4] = 0
        mine, n = _pack(codes), len(codes)
        head, tail = np.minimum(depth, 4), np.clip(depth - 4, 0, 4)
        span = lambda c, d: (np.searchsorted(self.four, c & ~open_[d], "left"), np.searchsorted(self.four, c | open_[d], "right"))
        first, after = span(mine[:n], head)
        low, high = span(mine[4 : n + 4], tail)
        wide = lambda x: x.astype(np.uint64)
        whole = head < 4  # the first four characters are not all fixed: the next ones are free
        begin = np.where(whole, wide(first) << np.uint64(32), (wide(first) << np.uint64(32)) | wide(low))
        end = np.where(whole, wide(after) << np.uint64(32), (wide(first) << np.uint64(32)) | wide(high))
        known = (after > first) & (whole | (high > low))
        begin, end = np.where(known, begin, np.uint64(0)), np.where(known, end, np.uint64(0))
        return np.searchsorted(self.key, begin, "left"), np.searchsorted(self.key, end, "left")


def _code(x: np.ndarray) -> np.ndarray:
    """Characters as numbers of 16 bits: 0 separates texts, 1 stands for those outside the plane."""
    return np.where(x > 0xFFFF, 1, x).astype(np.uint16)


def suffix_matches(array: SuffixArray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """document, place in it, item, place in it of every test suffix whose seed stands in the shard.

    In parts of about MATCHES: all matches of an item and a document are in one part, so an item of phrases that stand everywhere is taken document by document.
    """
    test = np.flatnonzero((items.chars != 0) & (items.place + items.seed[items.item] <= items.size[items.item]))
    if not len(test) or not len(array.key):
        return
    depth = np.zeros(len(items.chars), dtype=np.int64)
    depth[test] = items.seed[items.item[test]]
    low, high = (x[test] for x in array.ranges(_code(items.chars), depth))
    test, low, high = test[high > low], low[high > low], high[high > low]
    item = items.item[test]

    def expand(some: np.ndarray, docs: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        step = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(high[some] - low[some]) // MATCHES)) + 1, [len(some)]])
        for a, b in zip(step[:-1], step[1:]):
            part = some[a:b]
            counts = high[part] - low[part]
            where = array.order[np.repeat(low[part] - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())]
            suffix = np.repeat(test[part], counts)
            doc = np.searchsorted(array.begins, where, "right") - 1
            place = where - array.begins[doc]
            ok = (doc >= docs[0]) & (doc < docs[1]) & (place + depth[suffix] <= array.lengths[doc])
            parts.append((doc[ok], place[ok], items.item[suffix[ok]], items.place[suffix[ok]]))
        return tuple(np.concatenate(x) for x in zip(*parts))

    cut = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    sizes = np.add.reduceat(high - low, cut) if len(cut) else np.zeros(0, np.int64)
    begin, held = 0, 0
    for k in range(len(cut) + 1):
        if k == len(cut) or (held and held + sizes[k] > MATCHES):
            if held:
                some = np.arange(cut[begin], cut[k] if k < len(cut) else len(test))
                docs = len(array.lengths)
                slices = np.unique(np.linspace(0, docs, min(docs, -(-held // MATCHES)) + 1).astype(int))
                for a, b in zip(slices[:-1], slices[1:]):
                    yield expand(some, (a, b))
            begin, held = k, 0
        if k < len(cut):
            held += int(sizes[k])


def quoted(pairs: list[tuple[str, str]]) -> np.ndarray:
    """For each item and passage the characters of the item that stand in their best local alignment.

    A changed, missing or inserted character costs as much as three equal ones (an inserted one also three quarters of a character of the result). All pairs advance together, a character of the items at a time.
    """
    rows, width = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a = np.full((len(pairs), rows), 0xFFFFFFFE, dtype=np.uint32)
    b = np.full((len(pairs), width), 0xFFFFFFFF, dtype=np.uint32)
    for k, (item, passage) in enumerate(pairs):
        a[k, : len(item)] = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        b[k, : len(passage)] = np.frombuffer(passage.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    one = np.int64(1) << 24  # a score above, the place in the item where the alignment begins below (earlier is larger)
    slope = np.arange(width + 1, dtype=np.int64) * (_GAP * one)
    row = np.full((len(pairs), width + 1), one - 1, dtype=np.int64)
    best, span = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    for i in range(rows):
        fresh = one - 2 - i  # an alignment that begins behind this character
        new = row - _GAP * one
        new[:, 0] = fresh
        np.maximum(new[:, 1:], row[:, :-1] + np.where(b == a[:, i : i + 1], one, -_GAP * one), out=new[:, 1:])
        np.maximum(new, fresh, out=new)
        new += slope
        np.maximum.accumulate(new, axis=1, out=new)
        new -= slope
        row = new
        top = row.max(axis=1)
        better = (top >> 24) > best
        best[better] = top[better] >> 24
        span[better] = i + 1 - (one - 1 - (top[better] & (one - 1)))
    return span - (span - best) / (_GAP + 1)


def windows(p: np.ndarray, q: np.ndarray, width: int, cover: float, seed: int = SEED) -> list[tuple[int, int]]:
    """Lowest and highest offset (place in the document less place in the item) of every window of offsets that no other one contains and whose seeds hold at least cover different characters of the item."""
    order = np.argsort(p - q, kind="stable")
    offset, q = (p - q)[order], q[order]
    begins = np.flatnonzero(np.concatenate([[True], offset[1:] != offset[:-1]]))
    ends = np.searchsorted(offset, offset[begins] + width, "right")
    count = ends - begins
    likely = np.concatenate([[True], ends[1:] > ends[:-1]]) & (count + (seed - 1) * np.minimum(count, cover / seed) >= cover)
    out = []
    for b, e in zip(begins[likely], ends[likely]):
        if np.minimum(np.diff(np.unique(q[b:e])), seed).sum() + seed >= cover:
            out.append((int(offset[b]), int(offset[e - 1])))
    return out


def _shard_leaks(ids: np.ndarray, texts: list[str], items: Items, share: float) -> pd.DataFrame:
    rows = []
    for doc, place, item, j in suffix_matches(SuffixArray(texts), items):
        if not len(doc):
            continue
        order = np.lexsort((place, item, doc))
        doc, place, item, j = doc[order], place[order], item[order], j[order]
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
        ends = np.concatenate([cut[1:], [len(doc)]])
        size = np.array([len(t) for t in items.texts])
        least, chosen = HINT * share * size[item[cut]], []
        for s, e, cover in zip(cut, ends, least):
            seed = int(items.seed[item[s]])
            if e - s + (seed - 1) * min(e - s, cover / seed) < cover:
                continue
            text = items.texts[item[s]]
            for low, high in windows(place[s:e], j[s:e], len(text) // 6 + 16, cover, seed):
                begin, end = max(0, low - 20), high + len(text) + 20
                chosen.append((int(s), int(e), texts[doc[s]][begin:end]))
        chosen.sort(key=lambda x: (len(x[2]), len(items.texts[item[x[0]]])))  # alike in length: little padding
        spans: dict[tuple[int, int], float] = {}  # the best passage of each document and item
        for at in range(0, len(chosen), 64):
            batch = chosen[at : at + 64]
            given = quoted([(items.texts[item[s]], passage) for s, _, passage in batch])
            for (s, e, _), span in zip(batch, given):
                spans[s, e] = max(spans.get((s, e), 0.0), float(span))
        for (s, e), span in spans.items():
            text, p, q = items.texts[item[s]], place[s:e], j[s:e]
            if span < share * len(text):
                continue
            # longest run of consecutive suffixes on one diagonal
            diagonal = np.lexsort((q, p - q))
            dp, dq = (p - q)[diagonal], q[diagonal]
            breaks = np.flatnonzero(np.concatenate([[True], (dp[1:] != dp[:-1]) | (dq[1:] != dq[:-1] + 1)]))
            runs = np.diff(np.concatenate([breaks, [len(dp)]]))
            r = int(runs.argmax())
            first = diagonal[breaks[r]]
            rows.append((int(ids[doc[s]]), int(items.ids[item[s]]), span / len(text), int(runs[r]) + int(items.seed[item[s]]) - 1, int(p[first]), int(q[first])))
    short = [k for k, t in enumerate(items.texts) if 0 < len(t) < SEED]
    for k in short:
        t = items.texts[k]
        rows += [(int(i), int(items.ids[k]), 1.0, len(t), x.find(t), 0) for i, x in zip(ids, texts) if t in x]
    return pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "longest", "doc_place", "item_place"])


SCHEMA = "doc_id bigint, item_id bigint, share double, longest int, doc_place int, item_place int"


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, item_id, share, longest, doc_place, item_place: documents that give, in one passage, at least this share of an item.

    share is the part of the item that the passage gives unchanged, longest the longest verbatim match and where it stands in the two (of letters and digits only).
    Null ids or texts and items without letters give nothing; items shorter than a seed must stand whole, one of 8 to 31 characters needs a verbatim stretch of a quarter of it.
    """
    spark = documents.sparkSession
    wanted = items.select("item_id", passage_key(F.col("text")).alias("text")).where("item_id is not null and text <> ''")
    total = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // ITEM_BLOCK))
    docs = documents.select("doc_id", passage_key(F.col("text")).alias("text")).where("doc_id is not null and text <> ''")
    out = spark.createDataFrame([], SCHEMA)
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(rows)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            block = Items.of(sent.value, share)
            ids, texts, size = [], [], 0
            for batch in batches:
                for i, t in zip(batch["doc_id"], batch["text"]):
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                    if size >= SHARD:
                        yield _shard_leaks(np.array(ids), texts, block, share)
                        ids, texts, size = [], [], 0
            if texts:
                yield _shard_leaks(np.array(ids), texts, block, share)

        found = docs.mapInPandas(search, SCHEMA)
        out = found if blocks == 1 else out.unionByName(found)
    return out


def clean_documents(documents: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """The documents that give no item away."""
    return documents.join(leaks(documents, items, share).select("doc_id").distinct(), "doc_id", "left_anti")
