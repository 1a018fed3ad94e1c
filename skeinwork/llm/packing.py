"""Filling containers of fixed capacity with documents, by patterns fitted to the histogram of their lengths."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.words import pieces
from skeinwork.operators.unpack import buffers
from skeinwork.session import spread, stage

#: Lengths are rounded up to so many steps of a block.
STEPS = 128
#: Documents of a pattern, at most.
DOCS = 3
#: Items whose ordinals one task numbers, on average.
CHUNK = 200_000


def count_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Matches of ``[A-Za-z]+|[0-9]{1,3}|[^A-Za-z0-9 \\t\\r\\n]`` in every row of a UTF-8 buffer."""
    n = len(data)
    if not n:
        return np.zeros(len(offsets) - 1, np.int64)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    digit = (data >= 48) & (data <= 57)
    blank = (data == 32) | (data == 9) | (data == 10) | (data == 13)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:-1]
    token = ~letter & ~digit & ~blank & ((data & 0xC0) != 0x80)
    token[1:] |= letter[1:] & (first[1:] | ~letter[:-1])
    token[0] |= letter[0]
    run = digit.copy()
    run[1:] &= first[1:] | ~digit[:-1]
    at = np.arange(n, dtype=np.int64)
    since = at - np.maximum.accumulate(np.where(run, at, 0))
    token |= digit & (since % 3 == 0)
    upto = np.append(0, np.cumsum(token))
    return upto[offsets[1:]] - upto[offsets[:-1]]


def token_counts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id``, ``n_tokens``; null texts have 0 tokens."""
    schema = T.StructType([T.StructField("id", df.schema[id_column].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in (part for whole in batches for part in pieces(whole, 1, 10_000)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count_tokens(*buffers(b.column(1))))], names=schema.names)

    return spread(df.select(df[id_column], df[text_column])).mapInArrow(run, schema)


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        s = np.linalg.solve(a, b)
        if np.abs(a @ s - b).max() <= 1e-8 * max(1.0, float(np.abs(b).max())):
            return s
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(a, b, rcond=1e-10)[0]


def fit(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson: x >= 0 with the least |a x - b|."""
    n = a.shape[1]
    gram, x, active = a.T @ a, np.zeros(n), np.zeros(n, bool)
    rhs = a.T @ b
    tiny = 1e-9 * max(1.0, float(np.abs(rhs).max(initial=0)))
    blocked = np.zeros(n, bool)
    for _ in range(rounds):
        slope = rhs - gram @ x
        slope[active | blocked] = -np.inf
        j = int(np.argmax(slope)) if n else 0
        if not n or slope[j] <= tiny:
            break
        active[j] = True
        while True:
            k = np.flatnonzero(active)
            s = _solve(gram[np.ix_(k, k)], rhs[k])
            bad = s <= tiny
            if not bad.any():
                x[:] = 0
                x[k] = s
                blocked[:] = False
                break
            old = x[k]
            span = old[bad] - s[bad]
            step = float(np.min(np.where(span > 0, old[bad] / np.where(span > 0, span, 1), 0)))
            x[k] = np.maximum(old + step * (s - old), 0)
            gone = k[bad & (x[k] <= tiny)]
            if not len(gone):
                gone = k[bad]
            x[gone] = 0
            active[gone] = False
            if j in gone:
                blocked[j] = True
            if not active.any():
                break
    return x


def patterns(steps: int, docs: int) -> list[tuple[int, ...]]:
    """Length patterns, in steps and descending, of at most ``docs`` documents that fill ``steps`` exactly."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, head: tuple[int, ...]) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < docs:
            for size in range(min(left, most), 0, -1):
                if size * (docs - len(head)) < left:
                    break
                grow(left - size, size, (*head, size))

    grow(steps, steps, ())
    return out


@dataclass
class Block:
    """``count`` blocks filled alike: ``slots`` has how many items of each kind (heavy, step) a block takes."""

    slots: dict[tuple[int, int], int]
    count: int
    used: int = 0
    heavy: bool = False


def pack_histogram(histogram: dict[tuple[int, int], int], steps: int = STEPS, docs: int = DOCS) -> list[Block]:
    """Blocks that take every item of a histogram: kind (heavy, length in steps) -> number of items.

    A heavy item is the rest of a document that fills further blocks on its own, so a block takes at most one of them.
    Patterns of few documents are fitted to the histogram (non-negative least squares), repeat counts are rounded down and
    cut where they ask for more items than there are; the residual goes to the fullest block with room, longest items
    first. All work is per kind and pattern, however many items there are.
    """
    left = {k: int(c) for k, c in histogram.items() if c > 0}
    kinds = sorted(left)
    row = {k: i for i, k in enumerate(kinds)}
    blocks: list[Block] = []
    columns: list[dict[tuple[int, int], int]] = []
    for p in patterns(steps, docs):
        light = [(0, s) for s in p]
        for heavy in [None, *sorted(set(p))]:
            slots: dict[tuple[int, int], int] = defaultdict(int)
            for i, k in enumerate(light):
                slots[(1, heavy) if heavy is not None and i == p.index(heavy) else k] += 1
            if all(k in row for k in slots):
                columns.append(dict(slots))
    if columns:
        a = np.zeros((len(kinds), len(columns)))
        for j, slots in enumerate(columns):
            for k, m in slots.items():
                a[row[k], j] = m
        h = np.array([left[k] for k in kinds], float)
        # long items are the hard ones to place: weigh rows by length
        weight = np.array([s for _, s in kinds], float)
        scale = max(1.0, float((weight * h).max()))
        x = fit(a * weight[:, None], h * weight / scale) * scale
        for j in np.argsort(-x, kind="stable"):
            slots = columns[j]
            n = min([int(x[j] + 1e-6), *(left[k] // m for k, m in slots.items())])
            if n > 0:
                blocks.append(Block(slots, n, steps, any(k[0] for k in slots)))
                for k, m in slots.items():
                    left[k] -= m * n
    # residual: by room, the fullest fitting blocks first
    open_by_room: dict[tuple[int, bool], list[Block]] = defaultdict(list)
    for kind in sorted((k for k in left if left[k]), key=lambda k: (-k[1], -k[0])):
        heavy, size = kind
        n = left[kind]
        for room in sorted({r for r, _ in open_by_room if r >= size}):
            for has_heavy in (True, False):
                if heavy and has_heavy:
                    continue
                todo, open_by_room[room, has_heavy] = open_by_room.pop((room, has_heavy), []), []
                for b in todo:
                    per = 1 if heavy else room // size
                    full = min(n // per, b.count)
                    for count, m in ((full, per), (1 if full < b.count and n - full * per else 0, n - full * per)):
                        if count and m:
                            new = Block(b.slots | {kind: b.slots.get(kind, 0) + m}, count, b.used + m * size, b.heavy or bool(heavy))
                            open_by_room[steps - new.used, new.heavy].append(new)
                            n -= count * m
                            b.count -= count
                    if b.count:
                        open_by_room[room, has_heavy].append(b)
                if not open_by_room[room, has_heavy]:
                    del open_by_room[room, has_heavy]
        per = 1 if heavy else steps // size
        for count, m in ((n // per, per), (1 if n % per else 0, n % per)):
            if count:
                new = Block({kind: m}, count, m * size, bool(heavy))
                open_by_room[steps - new.used, new.heavy].append(new)
    blocks += [b for bs in open_by_room.values() for b in bs]
    return blocks


@dataclass
class Plan:
    """Where the items of a capacity go. ``slots``: (heavy, step, begin, end, mult, first block); ``runs``: (extra, begin,
    end, mult, first container, size of a stretch) for the blocks that go with a heavy item of ``extra`` whole blocks."""

    block: int
    per_container: int
    slots: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)


def shape(capacity: int, mean: float) -> tuple[int, int]:
    """Tokens of a block and blocks of a container: blocks are halves of halves, while two mean documents fit in."""
    m = 1
    while m < 64 and capacity // (2 * m) >= max(2 * mean, 2):
        m *= 2
    return capacity // m, m


def slot_table(blocks: list[Block]) -> tuple[list[tuple[int, int, int, int, int, int]], int, list[tuple[int, int, int]]]:
    """Ranges of ordinals per kind -> blocks; the number of blocks; and stretches (first block, count, heavy kind) of them."""
    upto: dict[tuple[int, int], int] = defaultdict(int)
    out, stretches, at = [], [], 0
    for b in blocks:
        for (heavy, step), m in sorted(b.slots.items()):
            begin = upto[heavy, step]
            out.append((heavy, step, begin, begin + m * b.count, m, at))
            upto[heavy, step] += m * b.count
        stretches.append((at, b.count, int(b.heavy)))
        at += b.count
    return out, at, stretches


def join_units(units: dict[int, int], m: int) -> list[tuple[int, int, int, int]]:
    """Containers of ``m`` blocks for units of 1..m blocks: (size, first ordinal, end ordinal, ...) as pattern rows.

    ``units``: blocks of a unit -> number of units. Returns rows (size, begin, end, mult, first container): the unit of
    that size with ordinal o in [begin, end) goes to container first + (o - begin) // mult. Largest units first, gaps are
    filled with the largest units that fit.
    """
    left = {s: n for s, n in units.items() if n}
    upto: dict[int, int] = defaultdict(int)
    out, at = [], 0
    while any(left.values()):
        room, pattern = m, {}
        for s in sorted(left, reverse=True):
            if left[s] and s <= room:
                k = min(room // s, left[s])
                pattern[s] = k
                room -= k * s
        times = min(left[s] // k for s, k in pattern.items())
        for s, k in pattern.items():
            out.append((s, upto[s], upto[s] + k * times, k, at))
            upto[s] += k * times
            left[s] -= k * times
        at += times
    return out


def _ordinals(df: DataFrame, group: list[str], order: list[str], chunks: int) -> DataFrame:
    """``ordinal`` from 0 of each row within its group, without gathering a group in one task.

    Rows are numbered within (group, chunk), chunks being hashes of ``order``, and shifted by the rows of earlier chunks.
    """
    df = df.withColumn("chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    sizes = df.groupBy(*group, "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*group, "chunk", before.alias("before"))
    within = F.row_number().over(Window.partitionBy(*group, "chunk").orderBy(*order)) - 1
    return df.withColumn("within", within).join(sizes, [*group, "chunk"]).withColumn("ordinal", F.col("within") + F.col("before")).drop("within", "before", "chunk")


def pack(lengths: DataFrame, capacities: dict[int, int], steps: int = STEPS, docs: int = DOCS) -> DataFrame:
    """Assignment of documents to containers, for several capacities at once.

    ``lengths``: ``id``, ``n_tokens``, one row per document. ``capacities``: spec -> tokens of a container. Returns one row per
    piece: ``spec_id``, ``container`` (from 0 within its spec), ``doc_id``, ``part`` (from 0), ``n_parts``, ``first_token``,
    ``n_tokens``. A document is split only if it has more tokens than the capacity: into pieces of the capacity, each a
    container of its own, and the rest, which is packed like a document.

    Only histograms of lengths reach the driver (at most 2 * ``steps`` numbers and 64 unit sizes a spec); the patterns go
    back as a table of ordinal ranges, bounded alike, and documents find their container by their ordinal among the
    documents of their length. Where documents are short for the capacity, patterns of few documents fill blocks (a half, a
    quarter, ... of the container), a longer document brings whole blocks of its own, and blocks are joined to containers.

    Defined results: null lengths, 0 tokens and less give no piece (there is nothing to place); a null id is placed like any other;
    repeated rows are placed each; capacities below 1 raise ValueError; an empty table gives no rows.
    """
    if any(c is None or c < 1 for c in capacities.values()):
        raise ValueError("capacities must be positive")
    spark = lengths.sparkSession
    base = lengths.where("n_tokens > 0").select("id", "n_tokens")
    base = stage(base.withColumn("copy", F.monotonically_increasing_id()), "lengths")
    n, total = base.agg(F.count(F.lit(1)), F.sum(F.least("n_tokens", F.lit(max(capacities.values(), default=1))))).first()
    schema = "spec_id bigint, container bigint, doc_id bigint, part int, n_parts int, first_token bigint, n_tokens bigint"
    if not n or not capacities:
        return spark.createDataFrame([], schema)
    mean = total / n
    shapes = {s: shape(c, min(mean, c)) for s, c in capacities.items()}
    specs = spark.createDataFrame([(s, c, *shapes[s]) for s, c in capacities.items()], "spec_id bigint, capacity bigint, block bigint, per int")
    items = base.join(F.broadcast(specs))
    whole = F.floor(F.col("n_tokens") / F.col("capacity")).cast("bigint")
    exact = F.col("n_tokens") <= F.col("capacity")
    items = items.withColumn("full", F.when(exact, 0).otherwise(whole)).withColumn("rest", F.col("n_tokens") - F.col("full") * F.col("capacity"))
    # a rest is `extra` whole blocks and one block that it shares
    step = F.ceil(F.greatest(F.col("rest") - F.col("extra") * F.col("block"), F.lit(1)) * steps / F.col("block")).cast("int")
    items = items.withColumn("extra", F.least(F.ceil(F.col("rest") / F.col("block")) - 1, F.col("per") - 1).cast("int"))
    items = items.withColumn("step", F.least(step, F.lit(steps))).withColumn("heavy", (F.col("extra") > 0).cast("int"))
    # tokens beyond the last block's grid (capacity not a multiple of the block) have the container's slack
    packed = items.where("rest > 0")
    histogram: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    for r in packed.groupBy("spec_id", "heavy", "step").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram[r.spec_id][r.heavy, r.step] = r.n
    slots, stretches = [], []
    for s in capacities:
        rows, _, runs = slot_table(pack_histogram(histogram[s], steps, docs))
        slots += [(s, *r) for r in rows]
        stretches += [(s, *r) for r in runs]
    chunks = max(1, -(-n // CHUNK))
    slot_df = spark.createDataFrame(slots, "spec_id bigint, heavy int, step int, begin bigint, end bigint, mult bigint, first_block bigint")
    numbered = _ordinals(packed.select("spec_id", "heavy", "step", "id", "copy", "n_tokens", "full", "extra", "rest", "capacity"), ["spec_id", "heavy", "step"], ["copy"], chunks)
    on = ["spec_id", "heavy", "step"]
    placed = numbered.join(F.broadcast(slot_df), on).where((F.col("ordinal") >= F.col("begin")) & (F.col("ordinal") < F.col("end")))
    placed = placed.withColumn("block_id", F.col("first_block") + F.floor((F.col("ordinal") - F.col("begin")) / F.col("mult")))
    placed = stage(placed.select("spec_id", "id", "copy", "n_tokens", "full", "extra", "rest", "capacity", "block_id"), "placed")
    # a block with a heavy item is a unit of 1 + extra blocks
    units = placed.groupBy("spec_id", "block_id").agg((F.max("extra") + 1).alias("size"))
    counts: dict[int, dict[int, int]] = defaultdict(dict)
    for r in units.groupBy("spec_id", "size").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.spec_id][r.size] = r.n
    joins = [(s, *r) for s in capacities for r in join_units(counts[s], shapes[s][1])]
    first_full = {s: max((r[5] + (r[3] - r[2]) // r[4] for r in joins if r[0] == s), default=0) for s in capacities}
    join_df = spark.createDataFrame(joins, "spec_id bigint, size int, begin bigint, end bigint, mult bigint, first bigint")
    unit_at = _ordinals(units, ["spec_id", "size"], ["block_id"], chunks).join(F.broadcast(join_df), ["spec_id", "size"])
    unit_at = unit_at.where((F.col("ordinal") >= F.col("begin")) & (F.col("ordinal") < F.col("end")))
    unit_at = unit_at.select("spec_id", "block_id", (F.col("first") + F.floor((F.col("ordinal") - F.col("begin")) / F.col("mult"))).cast("bigint").alias("container"))
    n_parts = (F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0)).cast("int").alias("n_parts")
    rests = placed.join(unit_at, ["spec_id", "block_id"]).select(
        "spec_id", "container", F.col("id").alias("doc_id"), F.col("full").cast("int").alias("part"), n_parts, (F.col("full") * F.col("capacity")).alias("first_token"), F.col("rest").alias("n_tokens")
    )
    # full pieces: containers of their own, numbered behind the others
    long = items.where("full > 0").select("spec_id", "id", "copy", "n_tokens", "full", "rest", "capacity")
    long = _prefix_sums(long, chunks)
    start = F.create_map(*[F.lit(int(x)).cast("bigint") for s in capacities for x in (s, first_full[s])])[F.col("spec_id")]
    fulls = long.select("*", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("part")).select(
        "spec_id", (start + F.col("before") + F.col("part")).cast("bigint").alias("container"), F.col("id").alias("doc_id"), "part", n_parts, (F.col("part") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens")
    )
    return rests.unionByName(fulls)


def _prefix_sums(long: DataFrame, chunks: int) -> DataFrame:
    """``before``: full pieces of the documents ahead in the same spec, summed chunk by chunk."""
    long = long.withColumn("chunk", F.pmod(F.xxhash64("copy"), F.lit(chunks)).cast("int"))
    ahead = Window.unboundedPreceding, -1
    sizes = long.groupBy("spec_id", "chunk").agg(F.sum("full").alias("n"))
    sizes = sizes.select("spec_id", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("spec_id").orderBy("chunk").rowsBetween(*ahead)), F.lit(0)).alias("shift"))
    within = F.coalesce(F.sum("full").over(Window.partitionBy("spec_id", "chunk").orderBy("copy").rowsBetween(*ahead)), F.lit(0))
    return long.withColumn("within", within).join(sizes, ["spec_id", "chunk"]).withColumn("before", F.col("within") + F.col("shift"))
