"""Near-duplicate records: BK-trees over integer Hamming distances, one tree per shard.

Broadcasting the shard trees of the whole collection to every task would send data that grows with the collection, and
Hamming distances between unrelated texts concentrate so strongly that a tree over everything prunes nothing. So the shards are
made by content: records that share a band of MinHash values are in one shard, and a shard's tree travels to the one task that
searches it. A tree holds fingerprints of one bit for each of BITS MinHash values; children are keyed by their integer Hamming distance
to the parent and a search follows only the edges within the radius. What is found is then checked exactly.

With BANDS bands of ROWS values a pair at the threshold 0.6 shares no band with probability (1 - 0.6 ** 4) ** 64 = 1.4e-4, a
pair at 0.65 with 3.5e-6; the radius is five standard deviations above the mean distance at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdial.functions.text import text_key
from loomdial.llm.splits import components

BANDS, ROWS, BITS = 64, 4, 192
SHINGLE = 5
#: Rows of a shard searched by one task; larger shards are split into blocks, each pair of blocks a task of its own.
BLOCK = 2048
_SAMPLE = 64

_rng = np.random.default_rng(20240501)
_A = (_rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def radius(threshold: float) -> int:
    p = (1 - threshold) / 2
    return math.ceil(BITS * p + 5 * math.sqrt(BITS * p * (1 - p)))


def _shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run of k characters, where each text's runs begin, and which texts have any."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    has = np.flatnonzero(lengths >= k)
    if not len(has):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), has
    h = np.zeros(max(0, len(chars) - k + 1), dtype=np.uint64)
    for j in range(k):
        h *= np.uint64(0x100000001B3)
        h += chars[j : j + len(h)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    begins = np.concatenate([[0], np.cumsum(lengths)])[:-1][has]
    counts = lengths[has] - k + 1
    offsets = np.concatenate([[0], np.cumsum(counts)])[:-1]
    keep = np.repeat(begins - offsets, counts) + np.arange(counts.sum())
    return h[keep].astype(np.uint32), offsets, has


def signatures(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the texts that have shingles: their indices, band keys (n, BANDS) and fingerprints (n, BITS // 64)."""
    h, offsets, has = _shingle_hashes(texts, k)
    if not len(has):
        return has, np.zeros((0, BANDS), np.int64), np.zeros((0, BITS // 64), np.int64)
    least = np.empty((BANDS * ROWS, len(has)), dtype=np.uint32)
    for j in range(BANDS * ROWS):
        least[j] = np.minimum.reduceat(h * _A[j] + _B[j], offsets)
    bands = np.full((len(has), BANDS), 0xCBF29CE484222325, dtype=np.uint64)
    for r in range(ROWS):
        bands = (bands ^ least[r::ROWS].T) * np.uint64(0x9FB21C651E98DF25)
        bands ^= bands >> np.uint64(28)
    bands += np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = ((least[:BITS] * np.uint32(0x9E3779B1)) >> np.uint32(31)).T.astype(np.uint64)
    words = (bits.reshape(len(has), BITS // 64, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    return has, bands.view(np.int64), words.view(np.int64)


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    def __init__(self):
        self.root: list | None = None

    def add(self, print_: int, item: int) -> None:
        if self.root is None:
            self.root = [print_, [item], {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ print_).bit_count()
            if d == 0:
                node[1].append(item)
                return
            child = node[2].get(d)
            if child is None:
                node[2][d] = [print_, [item], {}]
                return
            node = child

    def within(self, print_: int, radius: int) -> Iterator[int]:
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = (node[0] ^ print_).bit_count()
            if d <= radius:
                yield from node[1]
            low, high = d - radius, d + radius
            stack += [c for e, c in node[2].items() if low <= e <= high]


def _search(ids, prints, blocks, radius: int) -> list[tuple[int, int]]:
    """Pairs within the radius in one shard, or between its two blocks (0 and 1; -1: all belong together)."""
    tree, found = BKTree(), []
    numbers = [sum((int(w) & 0xFFFFFFFFFFFFFFFF) << (64 * i) for i, w in enumerate(p)) for p in prints]
    if blocks[0] < 0:
        for item, p in zip(ids, numbers):
            found += [(item, other) for other in tree.within(p, radius)]
            tree.add(p, item)
    else:
        for item, p, b in zip(ids, numbers, blocks):
            if b == 0:
                tree.add(p, item)
        for item, p, b in zip(ids, numbers, blocks):
            if b == 1:
                found += [(item, other) for other in tree.within(p, radius)]
    return found


def _search_shards(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard; a shard may span batches."""
    words = [f"p{i}" for i in range(BITS // 64)]
    rest = None

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        shard, ids = part["shard"].to_numpy(), part["id"].to_numpy()
        prints, blocks = part[words].to_numpy(), part["block"].to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        size = np.diff(np.concatenate([begin, [len(shard)]]))
        two = begin[(size == 2)]
        two = two[(blocks[two] < 0) | (blocks[two] != blocks[two + 1])] if len(two) else two
        near = np.bitwise_count((prints[two] ^ prints[two + 1]).view(np.uint64)).sum(axis=1) <= radius  # a root and one child
        a, b = ids[two[near]], ids[two[near] + 1]
        more = [x for s, n in zip(begin[size > 2], size[size > 2]) for x in _search(ids[s : s + n].tolist(), prints[s : s + n], blocks[s : s + n], radius)]
        if more:
            more = np.array(more, dtype=np.int64)
            a, b = np.concatenate([a, more[:, 0]]), np.concatenate([b, more[:, 1]])
        out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
        return out[out.a != out.b].drop_duplicates()

    for batch in batches:
        part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(part):
            continue
        last = part["shard"].to_numpy()[-1]
        open_ = part["shard"].to_numpy() == last
        rest = part[open_]
        if not open_.all():
            yield pairs(part[~open_])
    if rest is not None and len(rest):
        yield pairs(rest)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.iloc[at : at + 2000]
            has, bands, words = signatures(part["text"].tolist())
            out = part.iloc[has][["id", "h1", "h2"]].copy()
            out["bands"] = [b.tobytes() for b in bands]
            for i in range(BITS // 64):
                out[f"p{i}"] = words[:, i]
            yield out


_PRINTS = ", ".join(f"p{i} bigint" for i in range(BITS // 64))


def _explode_bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = [f"p{i}" for i in range(BITS // 64)]
    for batch in batches:
        if len(batch):
            keys = np.frombuffer(b"".join(batch["bands"]), dtype=np.int64)
            yield pd.DataFrame({"key": keys, "id": np.repeat(batch["id"].to_numpy(), BANDS), **{w: np.repeat(batch[w].to_numpy(), BANDS) for w in words}})


def _check(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    def runs(t: str) -> set[str]:
        return {t[i : i + SHINGLE] for i in range(len(t) - SHINGLE + 1)}

    for batch in batches:
        keep = []
        for s, t in zip(batch["text_a"], batch["text_b"]):
            x, y = runs(s), runs(t)
            both = len(x & y)
            keep.append(both > 0 and both >= threshold * (len(x) + len(y) - both) - 1e-9)
        yield batch.loc[keep, ["a", "b"]]


def dialogue_text(dialogue: Column) -> Column:
    """Contents in order, joined; lower case; only ASCII letters, digits and U+4E00-9FA5."""
    return text_key(F.concat_ws("", F.coalesce(dialogue["content"], F.array().cast("array<string>"))))


class NearDuplicates:
    """Pairs of records whose sets of 5-character runs have a Jaccard similarity of threshold or more.

    records: id bigint, text string. Ids delivered again count once; null ids and texts shorter than a run have no pair. Records of
    the same text are one class with the smallest id as representative: only representatives are compared.
    """

    def __init__(self, records: DataFrame, threshold: float = 0.6):
        self.records = records.select("id", "text").where("id is not null and text is not null")
        self.threshold = threshold
        hashed = self.records.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
        self.members = hashed.where(F.length("text") >= SHINGLE).select("id", "h1", "h2").distinct()
        signed = hashed.mapInPandas(_sign, f"id bigint, h1 bigint, h2 bigint, bands binary, {_PRINTS}")
        words = [f"p{i}" for i in range(BITS // 64)]
        self.representatives = signed.groupBy("h1", "h2").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ["bands", *words]])
        sample = hashed.where(F.pmod("h1", F.lit(_SAMPLE)) == 0).dropDuplicates(["h1", "h2"])
        sampled = sample.mapInPandas(_sign, f"id bigint, h1 bigint, h2 bigint, bands binary, {_PRINTS}").mapInPandas(_explode_bands, f"key bigint, id bigint, {_PRINTS}")
        self.hot = sampled.groupBy("key").count().where(F.col("count") * _SAMPLE > BLOCK).select("key", F.ceil(F.col("count") * _SAMPLE / BLOCK).cast("int").alias("blocks"))

    def candidates(self) -> DataFrame:
        """Distinct pairs (a < b) of representatives that a tree search finds."""
        words = [f"p{i}" for i in range(BITS // 64)]
        rows = self.representatives.select("id", "bands", *words).mapInPandas(_explode_bands, f"key bigint, id bigint, {_PRINTS}")
        hot = self.hot.collect() if self.hot.limit(10_001).count() <= 10_000 else None  # keys of large shards; a shard has BLOCK rows or more
        if hot == []:
            rows = rows.select(F.col("key").alias("shard"), "id", *words, F.lit(-1).cast("byte").alias("block"))
        else:
            blocks = F.broadcast(self.hot.sparkSession.createDataFrame(hot, self.hot.schema)) if hot else self.hot
            own = F.pmod(F.xxhash64(F.lit(3), "id"), F.col("blocks")).cast("int")
            split = rows.join(blocks, "key", "left").withColumn("own", own)
            calm = split.where("blocks is null").select(F.col("key").alias("shard"), "id", *words, F.lit(-1).cast("byte").alias("block"))
            spread = split.where("blocks is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            first, second = F.least("own", "other"), F.greatest("own", "other")
            side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
            spread = spread.select(F.xxhash64("key", first, second).alias("shard"), "id", *words, side.cast("byte").alias("block"))
            rows = calm.unionByName(spread)
        most = radius(self.threshold)
        shards = rows.repartition("shard").sortWithinPartitions("shard")
        return shards.mapInPandas(lambda it: _search_shards(it, most), "a bigint, b bigint").distinct()

    def representative_pairs(self) -> DataFrame:
        """Pairs of representatives that pass the exact check."""
        texts = self.records.dropDuplicates(["id"])
        found = self.candidates()
        found = found.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        t = self.threshold
        return found.mapInPandas(lambda it: _check(it, t), "a bigint, b bigint")

    def classes(self) -> DataFrame:
        """id, representative of every record that has a run."""
        reps = self.members.groupBy("h1", "h2").agg(F.min("id").alias("representative"))
        return self.members.join(reps, ["h1", "h2"]).select("id", "representative")

    def pairs(self) -> DataFrame:
        """id_a < id_b of all records, copies too."""
        classes = self.classes()
        a = classes.select(F.col("id").alias("id_a"), F.col("representative").alias("a"))
        b = classes.select(F.col("id").alias("id_b"), F.col("representative").alias("b"))
        between = self.representative_pairs().join(a, "a").join(b, "b")
        copies = classes.join(classes.groupBy("representative").count().where("count > 1").select("representative"), "representative", "left_semi")
        within = copies.select(F.col("id").alias("id_a"), "representative").join(copies.select(F.col("id").alias("id_b"), "representative"), "representative").where("id_a < id_b")
        least, most = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
        return between.select(least.alias("id_a"), most.alias("id_b")).unionByName(within.select("id_a", "id_b"))

    def groups(self) -> DataFrame:
        """id, representative, group: every record with the group of records linked to it directly or through others (its own representative where there is none)."""
        linked = components(self.representative_pairs())
        return self.classes().join(linked.select(F.col("node").alias("representative"), F.col("component").alias("_g")), "representative", "left").select("id", "representative", F.coalesce("_g", "representative").alias("group"))


def similar_sessions(sessions: DataFrame, threshold: float = 0.6) -> NearDuplicates:
    return NearDuplicates(sessions.select(F.col("session_no").alias("id"), dialogue_text(F.col("dialogue")).alias("text")), threshold)
