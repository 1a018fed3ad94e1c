"""Pages whose texts are versions of one another: Hamming codes of their word sequences in binary tries.

A text is the set of its sequences of ``WORDS`` consecutive words. Minimum hashes of the set give a code of two bits a hash,
in which the bits that differ follow the similarity, and keys of three hashes each, which head one trie per key ("shard").
Within a shard the codes form a binary trie, which is joined with itself: pairs of nodes are walked down together, their
differing bits are summed, and a pair is dropped once the sum exceeds the error budget. What remains is checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.words import distinct, page_words, pieces, scramble
from skeinwork.operators.components import components
from skeinwork.operators.joins import BROADCAST_ROWS, join_key_stats, small
from skeinwork.session import extent, spread, stage

WORDS, ALIKE = 3, 0.45
#: Trie shards per text, hashes that agree within a shard, hashes of a code (two bits each).
SHARDS, AGREE, CODE = 56, 3, 128
HASHES = max(SHARDS * AGREE, CODE)
#: Rows of a shard that are joined in one piece. A larger shard is split into FINER ones by FINER_AGREE further hashes each.
TILE, FINER, FINER_AGREE = 2000, 24, 2
#: Node pairs with up to so many rows in either node are compared word by word, behind the first START bits.
LEAF, START = 8, 8
PAGES = 1000

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)


def budget(alike: float, sigmas: float = 3.0) -> int:
    """Differing bits of 2 * CODE that texts of similarity ``alike`` exceed with a chance of about one in a thousand."""
    p = 1 - alike
    return int(np.ceil(CODE * p + sigmas * np.sqrt(CODE * (1.5 * p - p * p))))


class Sketcher:
    """Sets of hashed word sequences and their sketches, for lists of pages."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 2_000_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def sets(self, pages: list[str]) -> list[np.ndarray]:
        """For each page the sorted distinct 32-bit hashes of its word sequences."""
        lens, words = [], []
        for p in pages:
            w = page_words(p)
            lens.append(len(w))
            words += w
        h = self._hashes(words)
        roll = np.zeros(max(len(h) - self.words + 1, 0), np.uint64)
        for k in range(self.words):
            roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(roll)]
        roll = (scramble(roll) >> np.uint64(32)).astype(np.uint32)
        out, at = [], 0
        for n in lens:
            out.append(distinct(roll[at : at + max(n - self.words + 1, 0)]))
            at += n
        return out


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shard keys, code words, and 16 bits of every minimum hash of a set."""
    x = scramble(s.astype(np.uint64))
    low = np.full(HASHES, np.uint64(2**64 - 1))
    for i in range(0, len(x), 4096):
        low = np.minimum(low, (x[i : i + 4096, None] * _MUL + _ADD).min(axis=0))
    mixed = scramble(low)
    bits = np.empty(2 * CODE, np.uint8)
    bits[0::2], bits[1::2] = mixed[:CODE] & np.uint64(1), (mixed[:CODE] >> np.uint64(1)) & np.uint64(1)
    code = np.packbits(bits).view(">u8").astype(np.uint64)
    heads = mixed[: SHARDS * AGREE].reshape(SHARDS, AGREE)
    key = np.arange(SHARDS, dtype=np.uint64)
    for k in range(AGREE):
        key = scramble(key * np.uint64(0x9E3779B97F4A7C15) + heads[:, k])
    return key, code, (mixed >> np.uint64(48)).astype(np.uint16).tobytes()


_FINER = np.array([_rng.choice(HASHES, FINER_AGREE, replace=False) for _ in range(256 * FINER)])


def finer_keys(key: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For each row of a shard ``FINER`` keys of smaller shards, from its shard's key and further minimum hashes.

    ``marks``: (rows, HASHES) of 16 bits. Which hashes these are depends on the shard, so that what one shard parts another one
    may still join. Rows of similarity s share each smaller shard with a chance of s ** FINER_AGREE.
    """
    out = np.empty((len(key), FINER), np.uint64)
    start = (key % np.uint64(256)).astype(np.int64) * FINER
    for j in range(FINER):
        k = scramble(key + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        for column in _FINER[start + j].T:
            k = scramble(k * np.uint64(0x9E3779B97F4A7C15) + marks[np.arange(len(key)), column].astype(np.uint64))
        out[:, j] = k
    return out


def trie_join(group: np.ndarray, side: np.ndarray, code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group whose codes differ in at most ``most`` bits.

    ``group``: ascending; ``side``: 0 for groups joined with themselves, else 1 and 2 for the two nodes to be joined;
    ``code``: (rows, words) of unsigned 64-bit words. All tries are walked at once, level by level: a node is a range of the
    sorted codes, a pair of nodes becomes up to four pairs of their children, and a pair whose differing bits exceed ``most`` is
    dropped with all below it. Behind the first ``START`` bits, pairs of small nodes take the rest of their path 64 bits a step.
    """
    order = np.lexsort((*code.T[::-1], side, group))
    g, s, c = group[order], side[order], code[order]
    n = len(g)
    cut = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])))
    end = np.append(cut[1:], n)
    alone = s[cut] == 0
    # roots: a group with itself, or its side 1 with its side 2
    one = np.flatnonzero(s[cut] == 1)
    one = one[(one + 1 < len(cut))]
    one = one[(g[cut[one]] == g[cut[one + 1]]) & (s[cut[one + 1]] == 2)]
    al, ah = np.append(cut[alone], cut[one]), np.append(end[alone], end[one])
    bl, bh = np.append(cut[alone], cut[one + 1]), np.append(end[alone], end[one + 1])
    err = np.zeros(len(al), np.int64)
    keep = ~((al == bl) & (ah - al < 2))
    al, ah, bl, bh, err = al[keep], ah[keep], bl[keep], bh[keep], err[keep]
    left, right = [], []
    for bit in range(64 * code.shape[1] + 1):
        if not len(al):
            break
        fine = (ah - al <= LEAF) & (bh - bl <= LEAF) & (bit >= START)
        if bit == 64 * code.shape[1]:
            fine[:] = True
        if fine.any():
            x, y = _rows(al[fine], ah[fine], bl[fine], bh[fine])
            if len(x):
                differ = np.zeros(len(x), np.int64)
                for w in range(code.shape[1]):
                    differ += np.bitwise_count(c[x, w] ^ c[y, w])
                    ok = differ <= most
                    x, y, differ = x[ok], y[ok], differ[ok]
                left.append(order[x])
                right.append(order[y])
            al, ah, bl, bh, err = al[~fine], ah[~fine], bl[~fine], bh[~fine], err[~fine]
            if not len(al):
                break
        word, shift = divmod(bit, 64)
        ones = np.append(0, np.cumsum((c[:, word] >> np.uint64(63 - shift)) & np.uint64(1)).astype(np.int64))
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = (al == bl) & (ah == bh)
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        other = ~same
        parts.append((am[other], ah[other], bl[other], bm[other], err[other] + 1))
        al, ah, bl, bh, err = (np.concatenate(p) for p in zip(*parts, strict=True))
        keep = (ah > al) & (bh > bl) & (err <= most) & ~((al == bl) & (ah - al < 2))
        al, ah, bl, bh, err = al[keep], ah[keep], bl[keep], bh[keep], err[keep]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _rows(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All row pairs of node pairs; of a node with itself each pair once."""
    na, nb = ah - al, bh - bl
    size = na * nb
    k = np.repeat(np.arange(len(al)), size)
    o = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
    x, y = al[k] + o // nb[k], bl[k] + o % nb[k]
    ok = (al[k] != bl[k]) | (x < y)
    return x[ok], y[ok]


_TEXTS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("seqs", T.BinaryType()),
    T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("marks", T.BinaryType()), *[T.StructField(f"c{w}", T.LongType()) for w in range(2 * CODE // 64)],
])


def _texts(df: DataFrame, id_column: str, page_column: str, words: int) -> DataFrame:
    """Per row: id, text class (128-bit hash of the set), the set, shard keys and code. Pages without a sequence are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        maker = Sketcher(words)
        for whole in batches:
            for batch in pieces(whole, 1, PAGES):
                sets = maker.sets(batch.column(1).to_pylist())
                rows = [i for i, s in enumerate(sets) if len(s)]
                if not rows:
                    continue
                digests = np.array([[h >> 64, h & (2**64 - 1)] for h in (xxhash.xxh3_128_intdigest(sets[i].tobytes()) for i in rows)], np.uint64).view(np.int64)
                deltas = [np.diff(sets[i], prepend=np.uint32(0)).tobytes() for i in rows]
                keys, codes, marks = zip(*(sketch(sets[i]) for i in rows), strict=True)
                codes = np.array(codes).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SHARDS), pa.array(np.concatenate(keys).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(deltas, pa.binary()), lists, pa.array(marks, pa.binary()), *[pa.array(codes[:, w]) for w in range(codes.shape[1])]],
                    names=_TEXTS.names,
                )

    rows = df.where(df[page_column].isNotNull() & df[id_column].isNotNull()).select(df[id_column].cast("string"), df[page_column])
    return spread(rows).mapInArrow(run, _TEXTS)


def _shard_join(most: int):  # noqa: ANN202
    names = ["a", "b"]

    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        get = lambda n: rows[n].to_numpy()
        key, i, j, block = get("key"), get("i"), get("j"), get("block")
        new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        group = np.cumsum(new)
        size = np.bincount(group)[group]
        own = size > 1
        if not own.any():
            return None
        side = np.where(i == j, 0, np.where(block == i, 1, 2))[own]
        code = np.stack([get(f"c{w}")[own].view(np.uint64) for w in range(2 * CODE // 64)], axis=1)
        x, y = trie_join(group[own], side, code, most)
        k = get("k1")[own]
        a, b = np.minimum(k[x], k[y]), np.maximum(k[x], k[y])
        both = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=names) if len(both) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < 100_000:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            # the last group may go on in the next batch
            tail = [rows[n].to_numpy() for n in ("key", "i", "j")]
            begun = np.flatnonzero((tail[0] != tail[0][-1]) | (tail[1] != tail[1][-1]) | (tail[2] != tail[2][-1]))
            stop = int(begun[-1]) + 1 if len(begun) else 0
            if stop and (out := pairs(rows.slice(0, stop))) is not None:
                yield out
            held = rows.slice(stop).to_batches()
            count = rows.num_rows - stop
        if held and (out := pairs(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return run


_CODES = [f"c{w}" for w in range(2 * CODE // 64)]


def _finer(rows: DataFrame) -> DataFrame:
    """``key``, ``k1`` of the smaller shards of ``rows`` (``key``, ``k1``, ``marks``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                b = whole.slice(at, 20_000)
                marks = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, HASHES)
                keys = finer_keys(b.column(0).to_numpy().view(np.uint64), marks)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(b.column(1).to_numpy(), FINER))], names=["key", "k1"])

    return rows.mapInArrow(run, "key bigint, k1 bigint")


def _shared(keys: DataFrame, label: str) -> DataFrame:
    """``key``, ``n`` of the shards with more than one row; counts are combined on the map side."""
    return stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), label)


def _candidates(texts: DataFrame, most: int) -> DataFrame:
    """Pairs (a < b) of text ids that lie within the error budget in some shard.

    Shards are counted first, by their keys alone: nearly all hold one text and go no further, so that codes move only for
    texts that have a partner. Shards of more than ``TILE`` texts are replaced by ``FINER`` smaller ones for each text, by further
    minimum hashes, so that work grows with the texts unless they really are alike. What is still larger then consists of texts of
    high similarity, most of which are links: it is cut into blocks by hash, and each pair of blocks is one piece of work.
    """
    keys = texts.select(F.explode("keys").alias("key"), "k1")
    shards = _shared(keys, "shards")
    hot = shards.where(F.col("n") > TILE).select("key")
    rows = keys.join(small(shards.where(F.col("n") <= TILE).select("key"), shards), "key").withColumn("blocks", F.lit(1))
    if extent(shards)[0] and shards.agg(F.max("n")).first()[0] > TILE:
        crowded = keys.join(small(hot), "key").join(texts.select("k1", "marks"), "k1").select("key", "k1", "marks")
        finer = stage(_finer(crowded), "finer-keys")
        counts = _shared(finer, "finer-shards").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("blocks"))
        rows = rows.unionByName(finer.join(small(counts), "key"))
    rows = stage(rows, "shard-rows")
    needed = rows.select("k1").distinct()
    codes = texts.join(small(needed, rows), "k1", "left_semi").select("k1", *_CODES)
    if extent(rows)[0] <= BROADCAST_ROWS:
        codes = F.broadcast(codes)
    block = F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "k1").join(codes, "k1")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(_shard_join(most), "a bigint, b bigint").distinct()


def _exact(alike: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep, share = [], []
            for k, (x, y) in enumerate(zip(left, right, strict=True)):
                a, b = (np.cumsum(np.frombuffer(v, np.uint32), dtype=np.uint32) for v in (x, y))
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                j = common / (len(both) - common)
                if j >= alike:
                    keep.append(k)
                    share.append(j)
            if keep:
                rows = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(share, pa.float64())], names=["a", "b", "similarity"])

    return run


def near_copies(df: DataFrame, id_column: str, page_column: str, words: int = WORDS, alike: float = ALIKE) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and the text of every record.

    Returns ``links`` (``a``, ``b``: representative ids of two texts, a < b; ``similarity``: distinct sequences of ``words`` words
    in both, divided by those in either, at least ``alike``) and ``members`` (``id``, ``representative``: the least id with the
    same set of sequences). Copies are members of one text and are never joined with one another, so the work and the
    result do not grow with the square of a group of copies.

    A pair at the threshold of 0.45 shares a shard with a chance of 99.5 % and exceeds the error budget with one of 0.1 %;
    more similar pairs are missed less often (0.5: 0.06 %, 0.6: 0.0002 %). Found pairs are exact up to collisions of 32-bit hashes.

    Defined results: records with a null id or page, and pages of fewer than ``words`` words, take no part; repeated records
    are one record; an id with several pages is a member of several texts; an empty table gives two empty ones.
    """
    texts = stage(_texts(df, id_column, page_column, words).withColumn("r", F.monotonically_increasing_id()), "texts")
    classes = texts.groupBy("k1", "k2").agg(F.min(F.struct("id", "r")).alias("kept"), F.count(F.lit(1)).alias("n"))
    copied = classes.where("n > 1").select("k1", "k2", F.col("kept.id").alias("representative"), F.col("kept.r").alias("kept"))
    # of the rows of a text one is kept; the others, copies and repeated records, are members only
    others = texts.select("id", "k1", "k2", "r").join(small(stage(copied, "copied")), ["k1", "k2"]).where("r <> kept")
    others = stage(others.select("r", "id", "representative"), "copies")
    single = texts.join(small(others.select("r"), others), "r", "left_anti")
    pairs = stage(_candidates(single, budget(alike)), "candidates")
    needed = pairs.select(F.col("a").alias("k1")).unionByName(pairs.select(F.col("b").alias("k1"))).distinct()
    sets = single.select("k1", "id", "seqs").join(small(needed, pairs), "k1", "left_semi")
    left, right = (sets.select(F.col("k1").alias(s), F.col("id").alias(f"id_{s}"), F.col("seqs").alias(f"seqs_{s}")) for s in "ab")
    both = pairs.join(left, "a").join(right, "b").select("id_a", "id_b", "seqs_a", "seqs_b").mapInArrow(_exact(alike), "a string, b string, similarity double")
    links = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").where("a <> b")
    members = others.where("id <> representative").select("id", "representative").distinct().unionByName(single.select("id", F.col("id").alias("representative")))
    return stage(links, "near-links"), members


def link_rows(links: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of records: links of representatives, each copy with its representative and with the texts linked to it.

    Copies are not paired with one another, and of two linked texts with copies each copy is paired with the other
    text's representative, so rows grow with copies, not with their square.
    """
    copies = stage(members.where("id <> representative"), "copied-members")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    carried = both.join(small(copies), both.a == copies.representative).select("id", F.col("b").alias("other"))
    rows = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(copies.select("id", F.col("representative").alias("other"))).unionByName(carried)
    return rows.where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record: ``id``, ``representative`` of its text, ``group_id`` (the least representative in reach) and
    ``n_links``: texts that its text is linked to."""
    found = components(links, "a", "b").select(F.col("node").alias("representative"), F.col("component").alias("group_id"))
    degree = links.select(F.col("a").alias("representative")).unionByName(links.select(F.col("b").alias("representative"))).groupBy("representative").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = members.groupBy("representative").agg(F.count(F.lit(1)).alias("n_records"))
    texts = stage(sizes.join(found, "representative", "left").join(degree, "representative", "left"), "grouped")
    total = texts.agg(F.sum("n_records")).first()[0] or 0
    out = join_key_stats(members, texts, ["representative"], "n_records", total)
    return out.select("id", "representative", F.coalesce("group_id", "representative").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def crawl_links(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    from skeinwork.sources.tables import table

    return near_copies(table(spark, root, "crawl"), "url_hash", "page")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of crawled pages whose texts are at least 0.45 alike."""
    return link_rows(*crawl_links(spark, root)).select(F.col("a").alias("url_hash_a"), F.col("b").alias("url_hash_b"))


def p1_groups(spark: SparkSession, root: str) -> DataFrame:
    """Every crawled page with its text class, its group of versions and its number of links."""
    return groups(*crawl_links(spark, root)).withColumnRenamed("id", "url_hash")
