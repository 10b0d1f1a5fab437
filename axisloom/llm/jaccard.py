"""Jaccard join on word shingles by adaptive multi-match prefixes.

Documents become sets of 64-bit shingle hashes; equal sets fall together first. Two different sets link
when their Jaccard similarity is at least ``threshold`` percent. One order of shingles, rarest first by a
count sketch over the whole corpus (fixed size, ties by hash), holds everywhere, so any two linked sets
share at least ``l`` shingles among the first ``n - ceil(threshold * n) + l`` of each, for every l.

1. Every document: set size and fingerprint, and the count sketch.
2. Every different set puts the shingles of its prefix into the shuffle. Its l grows with its size and with
   its estimated candidates, the sketch counts over its prefix. Shingles that the sketch says are hot are
   dealt over several tasks by a salt. A sorted pass keeps the shingles that another set has too; no group is
   held in memory.
3. A pair goes by the lesser l of the two. A set drops out unless it has as many shared shingles as the least
   l of any set that could fit its size asks for; then once more, counting only shingles shared with sets
   that are left and stand in its own or the next class of size. Ties to the first set of each such group of
   a shingle and a class make families of what remains.
4. Families are compared in blocks of at most ``block_sets`` sets and ``block_shingles`` shingles: within a
   block a pair that is not yet connected, has fitting sizes and shares min(l) prefix shingles is verified by
   exact intersection. A family beyond one block is first linked within blocks, then between the blocks'
   leaders, then across every two blocks that may still hold an unconnected pair. All of it is exact.
5. Components of the links.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm import common, words
from axisloom.llm.components import components

#: Every set's l is one more than this share of its size; estimated cost adds at most EXTRA.
LENGTHEN, EXTRA = 0.05, 7
#: Sketch: 2**SKETCH_BITS counters, whatever the corpus.
SKETCH_BITS = 21
_CHUNKS = 32


def _fingerprint(s: np.ndarray) -> np.uint64:
    return words.mix(np.array([np.sum(words.mix(s ^ words.RUN[13]), dtype=np.uint64)]) + np.uint64(len(s)))[0]


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    data, off = common.text_buffers(column)
    for i, j in common.groups(off):
        _, _, hashes, word_off = words.document_words(data, off[i : j + 1], words.BLANK_WORDS)
        yield from words.shingles(hashes, word_off, k)


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


SIGNATURE = "doc long, n int, fp long, chunk int, counts binary"


def _sign(k: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        schema = pa.schema([("doc", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            n, fp = [], []
            for s in _sets(batch.column("text"), k):
                n.append(len(s))
                fp.append(_fingerprint(s) if len(s) else np.uint64(0))
                if fp[-1] not in seen:  # copies met by this task count once, unless some 500,000 others lie between them
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(fp[-1])
                    np.add.at(sketch, _bucket(s), np.uint32(1))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int32()), common.longs(np.array(fp, np.uint64)), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], schema=schema)
        if sketch.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, _CHUNKS)]
            none = pa.nulls(_CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(_CHUNKS, pa.int32()), none, pa.array(range(_CHUNKS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return step


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the sketches of a partition chunk by chunk: at most one row a chunk goes on."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, x in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(x), np.uint32)
            sums[c] = np.minimum(sums[c].astype(np.uint64) + part, np.uint64(0xFFFFFFFF)).astype(np.uint32) if c in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["chunk", "counts"])


def _levels(sketch: np.ndarray) -> np.ndarray:
    """Counts as 16-bit ranks on a logarithmic scale: the order in which shingles stand."""
    return np.minimum(65535, np.rint(np.log2(sketch.astype(np.float64) + 1) * 1024)).astype(np.uint16)


class Prefixes:
    """Order and prefixes under one sketch."""

    def __init__(self, sketch: np.ndarray, threshold: int):
        self.levels, self.threshold = _levels(sketch), threshold
        held = sketch[sketch > 0]
        #: What a counter holds by chance, from shingles other than the one asked for.
        self.noise = float(np.median(held)) if len(held) else 0.0
        self.sketch = sketch

    def plain(self, n: int) -> int:
        return n - -(-self.threshold * n // 100) + 1

    def least_l(self, n: int) -> int:
        """No set of n or more shingles has a smaller l."""
        return max(1, min(1 + int(LENGTHEN * n), -(-self.threshold * n // 100)))

    def of(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The prefix of a sorted set, rarest first, and its l; an l never exceeds the overlap that any link needs."""
        n = len(s)
        bucket = _bucket(s)
        order = np.argsort(self.levels[bucket], kind="stable")
        plain = self.plain(n)
        held = self.sketch[bucket[order[:plain]]]
        extra = np.maximum(held.astype(np.float64) - 2 * self.noise, 0.0).mean() if plain else 0.0
        l = min(self.least_l(n) + min(EXTRA, int(np.log2(1 + extra))), max(1, -(-self.threshold * n // 100)))
        return s[order[: plain + l - 1]], l


_held: list = []


def _order(counts: bytes, threshold: int) -> Prefixes:
    """Made once for each sketch that a Python worker is sent."""
    if not _held or _held[0] is not counts or _held[1] != threshold:
        _held[:] = [counts, threshold, Prefixes(np.frombuffer(counts, np.uint32), threshold)]
    return _held[2]


PREFIX = "token long, salt int, fp long, n int, l int, tier int"  # l: least_l of the smallest set that fits


def _emit(k: int, sketch, threshold: int, hot_rows: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = _order(sketch.value, threshold), set()
        for batch in batches:
            tokens, meta, sizes = [], [], []
            for s in _sets(batch.column("text"), k):
                if not len(s) or (fp := _fingerprint(s)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(fp)
                prefix, _ = order.of(s)
                tokens.append(prefix)
                sizes.append(len(prefix))
                meta.append((fp, len(s), order.least_l(-(-threshold * len(s) // 100)), order.plain(len(s))))
            if not sizes:
                continue
            token, size = np.concatenate(tokens), np.array(sizes)
            fp, n, l, plain = (np.repeat(np.array(x), size) for x in zip(*meta, strict=True))
            place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            tier = np.maximum(1, place - plain + 2)
            parts = np.maximum(1, order.sketch[_bucket(token)].astype(np.int64) // hot_rows)
            salt = (words.mix(fp.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
            salt[parts == 1] = -1
            for at in range(0, len(token), 50_000):
                cut = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([common.longs(token[cut]), pa.array(salt[cut]), common.longs(fp.astype(np.uint64)[cut]), pa.array(n[cut].astype(np.int32)), pa.array(l[cut].astype(np.int32)), pa.array(tier[cut].astype(np.int32))], names=["token", "salt", "fp", "n", "l", "tier"])

    return step


TIES = "fp long, n int, l int, tier int, token long"


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (token, salt, fp): each set's shingles that another set has too, streaming.

    Held between batches: the open group's first row, its last fp and whether the first row went out. All rows
    of a salted shingle go on, as other salts hold more of its sets.
    """
    names = ["token", "salt", "fp", "n", "l", "tier"]
    head, last_fp, out_yet = None, None, False
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(cols[0]):
            continue
        if head is not None:
            cols = [np.concatenate([[h], c]) for h, c in zip(head, cols, strict=True)]
        token, salt, fp = cols[:3]
        size = len(token)
        new = np.ones(size, bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        fresh = new.copy()
        fresh[1:] |= fp[1:] != fp[:-1]
        if head is not None and size > 1 and not new[1]:
            fresh[1] = fp[1] != last_fp
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        differ = np.bincount(group[fresh], minlength=len(begin))
        if out_yet:
            differ[0] = max(differ[0], 2)
        keep = fresh & ((differ[group] > 1) | (salt >= 0))
        if out_yet:
            keep[0] = False
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(fp[keep]), *(pa.array(c[keep].astype(np.int32)) for c in cols[3:]), pa.array(token[keep])], names=["fp", "n", "l", "tier", "token"])
        at = begin[-1]
        out_yet = bool(differ[-1] > 1 or salt[-1] >= 0)
        head, last_fp = [c[at] for c in cols], fp[-1]


LINK = "a long, b long"


def _compare(threshold: int, sketch):
    """Links of one unit: sets of one or two sides. Emits a link only where it joins two parts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        order = _order(sketch.value, threshold)
        held: dict[int, tuple] = {}
        for fp, part, side, s in zip(*(table.column(c).to_pylist() for c in ("fp", "part", "side", "shingles")), strict=True):
            held.setdefault(fp, (part, side, np.frombuffer(s, np.uint64)))
        rows = sorted(held.items(), key=lambda x: (len(x[1][2]), x[0]))
        a, b = link_sets([x[1][2] for x in rows], [x[1][0] for x in rows], [x[1][1] for x in rows], order)
        fp = np.array([x[0] for x in rows], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return step


def link_sets(sets: list[np.ndarray], parts: list, sides: list[int], order: Prefixes) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs that join parts, of sets in ascending order of size.

    Sets of one part are connected already. Pairs of one side above 0 were compared before and are left out.
    """
    n = len(sets)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    off = np.concatenate([[0], np.cumsum(size)])
    made = [order.of(s) for s in sets]
    own_l = np.array([l for _, l in made])
    prefix = [np.searchsorted(names, p) for p, _ in made]
    plain = np.array([order.plain(int(x)) for x in size])
    p_size = np.array([len(p) for p in prefix])
    p_flat, p_off = np.concatenate(prefix), np.concatenate([[0], np.cumsum(p_size)])
    tier = np.maximum(1, np.arange(len(p_flat)) - np.repeat(p_off[:-1] + plain, p_size) + 2)
    label = np.unique(np.array([hash(p) for p in parts]), return_inverse=True)[1]
    side = np.array(sides)
    # postings: for each shingle the sets that have it in their prefix, in ascending order
    by_token = np.argsort(p_flat, kind="stable")
    owner = np.repeat(np.arange(n), p_size)[by_token]
    posted = tier[by_token]
    token_off = np.searchsorted(p_flat[by_token], np.arange(len(names) + 1))
    place = np.empty(len(p_flat), np.int64)
    place[by_token] = np.arange(len(p_flat))
    inside = np.zeros(len(names), bool)
    fits = np.searchsorted(order.threshold * size, 100 * size, "right")
    out_a, out_b = [], []
    for i in range(n - 1):
        mine = slice(p_off[i], p_off[i + 1])
        behind = place[mine] + 1  # postings after its own are of later, larger sets
        at, _ = _ranges(behind, token_off[p_flat[mine] + 1] - behind)
        if not len(at):
            continue
        j = owner[at]
        own_tier = np.repeat(tier[mine], token_off[p_flat[mine] + 1] - behind)
        l = np.minimum(own_l[j], own_l[i])
        ok = (j < fits[i]) & (own_tier <= l) & (posted[at] <= l) & (label[j] != label[i]) & ((side[j] != side[i]) | (side[i] == 0))
        shared = np.bincount(j[ok], minlength=n)
        j = np.flatnonzero(shared)
        j = j[shared[j] >= np.minimum(own_l[j], own_l[i])]
        if not len(j):
            continue
        whole = slice(off[i], off[i + 1])
        inside[flat[whole]] = True
        at, spans = _ranges(off[j], size[j])
        both = np.add.reduceat(inside[flat[at]].astype(np.int64), spans)
        inside[flat[whole]] = False
        for x in j[100 * both >= order.threshold * (size[i] + size[j] - both)].tolist():
            if label[x] != label[i]:
                out_a.append(i)
                out_b.append(x)
                label[label == label[x]] = label[i]
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def _ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of ranges that aren't empty, and where each range begins among them."""
    spans = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(begin - spans, count), spans


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    return (words.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(size)).astype(np.int64)


#: Keys with more than the HEAVY-th part of all rows are fewer than HEAVY, so a table of them may be sent everywhere.
HEAVY = 100_000


def _spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, by: str, alone: str = "false") -> DataFrame:
    """Left outer join with a table of one row for each key; ``weight`` there is how many of ``total`` left rows have it.

    Heavy keys' rows are sent to every task and met there. The others are shuffled by key; left rows that have met
    theirs, and those for which ``alone`` holds (they have no match), are dealt by ``by`` instead.
    """
    names = [c for c in right.columns if c not in (*keys, weight)]
    right = right.select(*keys, weight, F.struct(*names).alias("found"))
    heavy = F.col(weight) > total // HEAVY
    met = left.join(F.broadcast(right.where(heavy).select(*keys, F.col("found").alias("near"))), keys, "left")
    met = met.withColumn("free", F.col("near").isNotNull() | F.expr(alone)).withColumn("dealt", F.when(F.col("free"), F.xxhash64(by)).otherwise(F.xxhash64(*keys)))
    rest = right.where(~heavy).select(*keys, F.col("found").alias("far"), F.xxhash64(*keys).alias("dealt"), F.lit(False).alias("free"))
    both = met.join(rest, ["dealt", "free", *keys], "left").withColumn("found", F.coalesce("near", "far"))
    return both.select(*left.columns, *(F.col("found").getField(c).alias(c) for c in names))


def _wanted_sets(docs: DataFrame, wanted: DataFrame, k: int, filter_bits: int = 1 << 26) -> DataFrame:
    """``wanted`` (doc, fp and more, one row for each fp) with ``shingles``, without ``doc``.

    A bitmap of fixed size over the wanted ids goes to the executors, so that only those documents are split
    again; the join that follows makes it exact.
    """
    spark = docs.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(_bits(batch.column("doc").to_numpy(), filter_bits))
            word = np.bincount(np.searchsorted(u := np.unique(bit >> 5), bit >> 5), weights=np.ldexp(1.0, bit & 31), minlength=len(u))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(word.astype(np.int64))], names=["word", "bits"])

    held = np.zeros(filter_bits >> 5, np.uint32)
    folded = wanted.where("doc is not null").select("doc").mapInArrow(pack, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    for batch in folded.toArrow().to_batches():
        held[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(zlib.compress(held.tobytes(), 1))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(zlib.decompress(sent.value), np.uint32)
        for batch in batches:
            bit = _bits(batch.column("doc").to_numpy(), filter_bits)
            batch = batch.filter(pa.array((bitmap[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool)))
            sets = [s for s in _sets(batch.column("text"), k)]
            doc = batch.column("doc").to_numpy()
            for at in range(0, len(sets), 500):
                part = sets[at : at + 500]
                yield pa.RecordBatch.from_arrays([pa.array(doc[at : at + 500]), common.longs(np.array([_fingerprint(s) for s in part], np.uint64)), pa.array([s.tobytes() for s in part], pa.binary())], names=["doc", "fp", "shingles"])

    found = docs.where("doc is not null").mapInArrow(step, "doc long, fp long, shingles binary")
    # rows that repeat id and text are side by side after the join's own shuffle, so this adds none
    return found.join(wanted, ["doc", "fp"]).dropDuplicates(["doc", "fp"]).drop("doc")


def _run_units(members: DataFrame, threshold: int, sketch) -> DataFrame:
    """Links from members (unit, fp, part, side, shingles); unit: any struct."""
    return members.select(F.xxhash64("unit").alias("unit"), "fp", "part", "side", "shingles").groupBy("unit").applyInArrow(_compare_table(threshold, sketch), LINK)


def _compare_table(threshold: int, sketch):
    inner = _compare(threshold, sketch)

    def unit(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(inner(iter(table.to_batches()))))

    return unit


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: int = 80,
    block_sets: int = 2000, block_shingles: int = 1_500_000, hot_rows: int = 200_000,
) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_shingles``, ``component_id`` and ``n_copies``.

    ``component_id`` is the least id reachable by links, ``n_copies`` the number of rows with the very same
    set (1 without words). Documents without words or with null text have no set and are linked with nothing. A row with a null
    id keeps its null id, takes part in no link and has a null component. Rows are the nodes: two rows with
    one id and different texts belong to the components of their own texts.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    signed = common.written(own.mapInArrow(common.tidied(_sign(k)), SIGNATURE), "signatures")
    rows = signed.where("chunk is null").select("doc", "n", "fp")

    counts = signed.where("chunk is not null").select("chunk", "counts")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    width = len(sketch) // _CHUNKS
    for row in counts.repartition(_CHUNKS, "chunk").mapInArrow(_add_counts, "chunk int, counts binary").toLocalIterator():
        sketch[row.chunk * width : (row.chunk + 1) * width] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    sent = spark.sparkContext.broadcast(sketch.tobytes())

    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.where("doc is not null").mapInArrow(common.tidied(_emit(k, sent, threshold, hot_rows)), PREFIX).repartition(shuffled, "token", "salt").sortWithinPartitions("token", "salt", "fp")
    ties = common.written(dealt.mapInArrow(common.tidied(_tie), TIES), "ties")

    counted = F.col("tier") <= F.col("l")
    live = ties.groupBy("fp").agg(F.count_if(counted).alias("met"), F.first("l").alias("l")).where("met >= l").select("fp")
    # sizes that fit lie in one class or in neighbours: each set stands in its own group and in the next
    size_class = F.floor(F.log("n") / F.log(F.lit(100.8 / threshold)))
    placed = ties.join(live, "fp", "left_semi").withColumn("class", F.explode(F.array(size_class, size_class + 1)))
    firsts = placed.groupBy("token", "class").agg(F.min("fp").alias("hub"), F.max("fp").alias("last"), F.count("*").alias("rows")).where("hub <> last").drop("last")
    placed = _spread_join(placed, firsts, ["token", "class"], "rows", 2 * ties.count(), "fp")
    shared = common.written(placed.where("hub is not null").select("fp", "n", "l", "tier", "token", "hub"), "shared")
    live = shared.groupBy("fp", "n", "l").agg(F.count_distinct(F.when(counted, F.col("token"))).alias("met")).where("met >= l").select("fp", "n")
    edges = shared.select("fp", "hub").where("fp <> hub").distinct().join(live.select("fp"), "fp", "left_semi")
    family = components(edges, "fp", "hub").select(F.col("node").alias("fp"), F.col("root").alias("family"))
    members = family.join(live, "fp")
    sizes = members.groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("sets") / block_sets), F.ceil(F.col("shingles") / block_shingles)).cast("int")
    members = common.written(members.join(sizes.select("family", blocks.alias("blocks")), "family").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks"))), "members")

    reps = rows.where("doc is not null").groupBy("fp", "n").agg(F.min("doc").alias("doc"))
    wanted = members.select("fp", "n", "family", "block", "blocks").join(reps, ["fp", "n"])
    sets = common.written(_wanted_sets(own, wanted.select("doc", "fp", "family", "block", "blocks"), k), "sets")

    first = sets.select("fp", F.struct("family", "block").alias("unit"), F.col("fp").alias("part"), F.lit(0).alias("side"), "shingles")
    links = common.written(_run_units(first, threshold, sent), "links")
    if members.where("blocks > 1").limit(1).count():
        links = _across_blocks(members.where("blocks > 1"), sets.where("blocks > 1").select("fp", "shingles"), links, threshold, sent, block_sets)

    for table in (ties, shared, members, sets):
        common.dropped(table)
    root = components(links, "a", "b")
    doc_of = root.join(reps.withColumnRenamed("fp", "node"), "node")
    least = doc_of.groupBy("root").agg(F.min("doc").alias("least"))
    linked = doc_of.join(least, "root").select(F.col("node").alias("fp"), "n", "least")
    per_set = rows.groupBy("fp", "n").agg(F.min("doc").alias("first"), F.count("*").alias("n_copies")).join(linked, ["fp", "n"], "left")
    per_set = per_set.where("n > 0").select("fp", "n", F.coalesce("least", "first").alias("component"), "n_copies", F.col("n_copies").alias("rows"))
    # copies and documents without words, however many, are spread
    return _spread_join(rows, per_set, ["fp", "n"], "rows", rows.count(), "doc", "n = 0").select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def _across_blocks(wide: DataFrame, sets: DataFrame, links: DataFrame, threshold: int, sent, block_sets: int) -> DataFrame:
    """Families beyond one block: leaders of the parts found so far, then every two blocks not yet one part."""

    def parted(links: DataFrame) -> DataFrame:
        root = components(links, "a", "b").select(F.col("node").alias("fp"), F.col("root").alias("part"))
        return wide.join(root, "fp", "left").withColumn("part", F.coalesce("part", "fp"))

    leaders = parted(links).groupBy("family", "part").agg(F.min("fp").alias("fp"), F.count("*").alias("weight"))
    many = leaders.groupBy("family").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("groups"))
    unit = leaders.join(many, "family").select("fp", F.struct("family", F.pmod(F.xxhash64("fp"), F.col("groups")).alias("block")).alias("unit"), "part", F.lit(0).alias("side"))
    links = common.written(links.unionAll(_run_units(unit.join(sets, "fp"), threshold, sent)), "links")

    # Blocks anew: a part large enough has blocks of its own, others share.
    now = parted(links)
    heavy = now.groupBy("family", "part").agg(F.count("*").alias("weight"))
    now = now.join(heavy, ["family", "part"]).withColumn("own", F.col("weight") * 2 >= block_sets)
    slot = F.when(F.col("own"), F.struct(F.lit(True).alias("own"), F.col("part").alias("of"), F.pmod(F.xxhash64("fp"), F.ceil(F.col("weight") / block_sets)).alias("no")))
    slot = slot.otherwise(F.struct(F.lit(False).alias("own"), F.lit(0).cast("long").alias("of"), F.pmod(F.xxhash64("part"), F.col("blocks").cast("long")).alias("no")))
    now = common.written(now.withColumn("slot", slot).select("family", "fp", "part", "slot"), "slots")
    slots = now.select("family", "slot").distinct()
    pairs = slots.alias("x").join(slots.alias("y"), F.col("x.family") == F.col("y.family")).where("x.slot < y.slot or (x.slot = y.slot and not x.slot.own)")
    pairs = pairs.where("not (x.slot.own and y.slot.own and x.slot.of = y.slot.of)").select(F.col("x.family").alias("family"), F.col("x.slot").alias("p"), F.col("y.slot").alias("q"))
    dealt = pairs.select("family", F.struct("p", "q").alias("unit"), F.explode(F.array_distinct(F.array("p", "q"))).alias("slot"), (F.col("p") == F.col("q")).alias("same"))
    unit = now.join(dealt, ["family", "slot"]).select("fp", F.struct("family", "unit").alias("unit"), "part", F.when(F.col("same"), 0).when(F.col("slot") == F.col("unit.p"), 1).otherwise(2).alias("side"))
    return common.written(links.unionAll(_run_units(unit.join(sets, "fp"), threshold, sent)), "links")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each group of linked documents stays: that with the least id. Null ids stay.

    Of rows that repeat both id and text, one stays.
    """
    found = jaccard_components(docs, key, text, **how)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    stay = docs.join(kept, F.col(key) == F.col("kept_id"), "left_semi").dropDuplicates([key, text])
    return stay.unionAll(docs.where(F.col(key).isNull()))
