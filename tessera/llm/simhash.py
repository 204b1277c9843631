"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints: words of the text with A-Z lower-cased, shingles of ``width`` words (repeats
count, fewer words: the whole sequence), XXH64 with seed 42 of each; a bit is set if over half
the hashes have it. Without words the fingerprint is zero.

Two fingerprints within ``radius`` 3 have a value between them that is at most 2 bits from one
and 1 bit from the other. If they differ in 3 bits, one has an odd number of bits set and the
other an even number, so it is enough that even ones emit all variants within 2 bits and odd
ones within 1 bit. Variants are shuffled, each meets the fingerprints that emitted it, pairs are
deduplicated and verified.

A lossless filter goes before it: fingerprints within 3 bits agree on all but 3 of B blocks, so
one that shares no choice of B-3 blocks with another has no neighbour, and emits nothing. B is
chosen from the number of distinct fingerprints so that chance agreement stays rare.

Everything is on distinct fingerprints with their smallest doc_id: copies never form pairs.
Components are found by minimum labels along links, with a written table after each round.

Defined results: null text is empty; documents without words link to each other; rows that
repeat are linked; null doc_ids count as larger than any; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_path, new_path, packed, released, row_key, small_batches, spread, stored, unfolded, unpacked, whole_row

_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Hashes whose bits are counted at a time.
_BLOCK = 1 << 15


def fingerprint(text: bytes | None, width: int = 3) -> int:
    words = (text or b"").translate(_UPPER).split()  # bytes split at the six characters of a word gap
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    elif width == 3:
        shingles = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    else:
        shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    h = np.fromiter(map(_hash, shingles), np.uint64, len(shingles))
    return bits_of(h) & (1 << 64) - 1


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, 42)


def _fingerprints(width: int):
    def of(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), pa.array(fp, pa.int64())], [*(c for c in batch.schema.names if c != "text"), "fp"])

    return of


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, the row's key and fp, a signed long, of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", *row_key("doc_id", "text"), F.col("text").cast("binary").alias("text"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(released(_fingerprints(width)), "doc_id long, rk1 long, rk2 long, fp long")


def variants(fp: np.ndarray, reach: int) -> np.ndarray:
    """All values within ``reach`` (0 to 2) bits of each: one row per fingerprint."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    flips = [np.zeros(1, np.uint64)]
    if reach >= 1:
        flips.append(one)
    if reach >= 2:
        i, j = np.triu_indices(64, 1)
        flips.append(one[i] | one[j])
    return fp[:, None] ^ np.concatenate(flips)[None, :]


def _emit(radius: int):
    near, far = radius // 2, radius - radius // 2

    def of(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            odd = np.bitwise_count(fp) % 2 == 1
            for part, reach in ((fp[odd], near), (fp[~odd], far)):
                for at in range(0, len(part), 64):
                    own = part[at : at + 64]
                    v = variants(own, reach)
                    away = np.bitwise_count(v[0] ^ own[0]).astype(np.int8)
                    yield pa.RecordBatch.from_pydict({"v": v.ravel().view(np.int64), "away": np.tile(away, len(own)), "fp": np.repeat(own, v.shape[1]).view(np.int64)})

    return of


def block_edges(blocks: int) -> list[int]:
    return [round(64 * i / blocks) for i in range(blocks + 1)]


def _keys(blocks: int, radius: int):
    edges = block_edges(blocks)
    masks = [sum(((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False) if a in chosen) for chosen in map(set, itertools.combinations(edges[:-1], blocks - radius))]
    masks = np.array(masks, np.uint64)

    def of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch["fp"][at : at + 4096].to_numpy(zero_copy_only=False).view(np.uint64)
                k = fp[:, None] & masks[None, :]
                yield pa.RecordBatch.from_pydict({"k": k.ravel().view(np.int64), "m": np.tile(np.arange(len(masks), dtype=np.int16), len(fp)), "fp": np.repeat(fp, len(masks)).view(np.int64)})

    return of


def _blocks(n: int, radius: int) -> int:
    """Blocks with which ``n`` fingerprints seldom agree by chance."""
    bits = math.log2(max(n, 2)) + 10
    return next((b for b in range(radius + 3, 17) if 64 * (b - radius) / b >= bits), 16)


def _keyed(fps: DataFrame, blocks: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(k, m, fp): the blocks of each choice, and (m, k, held) of those that several share."""
    keyed = fps.mapInArrow(released(_keys(blocks, radius)), "k long, m short, fp long")
    # a fingerprint is alone in a key if the smallest and the largest there are the same
    shared = keyed.groupBy("m", "k").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("held"))
    return keyed, shared.filter("lo != hi").select("m", "k", "held")


def _alive(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """Fingerprints that share the blocks of some choice with another one."""
    keyed, shared = _keyed(distinct, _blocks(n, radius), radius)
    return keyed.join(stored(shared.select("m", "k"), "simhash-shared"), ["m", "k"], "left_semi").select("fp").distinct()


def links(distinct: DataFrame, n: int, radius: int = 3, filtered: bool = True) -> DataFrame:
    """Verified links (a, b) between fingerprints at ``radius`` or fewer bits, enough of them to
    connect all that are linked. ``distinct`` has one column fp; ``n`` is its number of rows.
    Unless ``filtered``, every fingerprint emits its ball.

    Of those that meet in a variant, the one nearest to it (at most 1 bit away) is linked to each
    of the others (at most 2 bits away): a star, not all pairs. Where all are 2 bits away, every
    two of them are 2 or 4 bits apart, and those at 2 also meet half-way, 1 bit from each.
    """
    if radius not in (2, 3):
        raise ValueError("radius must be 2 or 3")
    alive = _alive(distinct, n, radius) if filtered else distinct
    # few rows that become many: spread them, whatever their size
    emitted = spread(alive, F.col("fp")).mapInArrow(released(_emit(radius)), "v long, away byte, fp long")
    # at most 65 odd and 2081 even values meet in a variant: the ball bounds the list, not the data
    met = emitted.groupBy("v").agg(F.min(F.struct("away", "fp")).alias("c"), F.collect_list("fp").alias("fps"))
    met = met.filter("size(fps) > 1 AND c.away <= 1").select(F.col("c.fp").alias("a"), F.explode("fps").alias("b"))
    return met.filter("a != b").distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


#: Fingerprints that share the blocks of a choice and are compared with each other; blocks at the
#: second look at those that are more.
FEW_CODES, FINE_BLOCKS = 32, 10


def sparse_links(distinct: DataFrame, n: int, radius: int = 3, few: int = FEW_CODES) -> DataFrame:
    """What ``links`` connects, for fingerprints of which few have a neighbour. Any two within
    ``radius`` share the blocks of some choice. Where at most ``few`` share them, these are
    compared with each other. Those that share blocks with more are looked at again with finer
    blocks, and of them, those that still do emit their balls."""
    rest, found = distinct, None
    for blocks in sorted({_blocks(n, radius), max(FINE_BLOCKS, _blocks(n, radius))}):
        keyed, shared = _keyed(rest, blocks, radius)
        met = stored(keyed.join(stored(shared, "simhash-shared"), ["m", "k"]), "simhash-met")
        a, b = (met.filter(F.col("held") <= few).select("m", "k", F.col("fp").alias(x)) for x in "ab")
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
        own = a.join(b, ["m", "k"]).filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
        found = own if found is None else found.union(own)
        rest = stored(met.filter(F.col("held") > few).select("fp").distinct(), "simhash-crowd")
        if not rest.limit(1).count():
            return found
    return found.union(links(rest, n, radius, filtered=False))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(fp, label): the smallest ``label`` of ``nodes`` (fp, label) reachable over ``edges``
    (a, b). Labels spread along links and, by pointer jumping, along the labels themselves, so
    rounds grow with the logarithm of a component's length. Each round is written to the shared
    folder; the driver sees one count per round."""
    spark = nodes.sparkSession
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "simhash-edges")
    # roots are fingerprints; order: by label, then by value
    touched = both.select(F.col("a").alias("fp")).distinct()
    old = new_path(spark, "simhash-labels")
    nodes.join(touched, "fp", "left_semi").select("fp", "label").write.parquet(old)
    for _ in range(max_rounds):
        now = spark.read.parquet(old)
        spread = both.join(now, both.a == now.fp).groupBy("b").agg(F.min("label").alias("heard"))
        nxt = now.join(spread, now.fp == spread.b, "left").select("fp", "label", F.least("label", F.coalesce("heard", "label")).alias("new"))
        # pointer jumping: who held the label first may have heard of a smaller one by now
        owner = nxt.groupBy("label").agg(F.min("new").alias("jump"))
        nxt = nxt.join(owner, "label").select("fp", F.least("new", "jump").alias("label"), (F.least("new", "jump") < F.col("label")).alias("moved"))
        path = new_path(spark, "simhash-labels")
        nxt.write.parquet(path)
        drop_path(spark, old)
        old = path
        if spark.read.parquet(path).filter("moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("labels did not settle")
    return spark.read.parquet(old).select("fp", "label")


def _label() -> Column:
    """The order of documents: by doc_id, null last, then by content."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk1", "rk2")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, rk1, rk2, fp (signed long) of each document, and ``label``, the first document of
    its component; ``label.doc_id`` is the smallest doc_id reachable."""
    fps = stored(fingerprints(docs, width), "simhash-fps")
    nodes = stored(fps.groupBy("fp").agg(F.min(_label()).alias("label")), "simhash-nodes")
    found = components(nodes, links(nodes.select("fp"), nodes.count(), radius))
    ids = nodes.join(found.withColumnRenamed("label", "least"), "fp", "left").select("fp", F.coalesce("least", "label").alias("label"))
    return fps.join(stored(ids, "simhash-ids"), "fp")


# Similar documents ----------------------------------------------------------------------------


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Hashes of the set of shingles, in rising order."""
    words = (text or b"").translate(_UPPER).split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return np.unique(np.fromiter(map(_hash, shingles), np.uint64, len(shingles)))


#: Bands of minimum hashes, and hashes in each: sets that are 0.8 alike share no band once in 2e7.
BANDS, BAND_ROWS = 32, 4
#: Bands that bring near copies together before the others are looked at.
FIRST_BANDS = 4
_ODD = np.random.default_rng(4).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(h: np.ndarray) -> np.ndarray:
    """A key for each band of a set of hashes: of its least ones in several orders."""
    if not len(h):
        return np.empty(0, np.int64)
    least = np.full(len(_ODD), 2**64 - 1, np.uint64)
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (h[at : at + 4096, None] * _ODD[None, :]).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def bits_of(h: np.ndarray) -> int:
    """SimHash of a set of hashes, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[at : at + _BLOCK, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _described(width: int):
    names = ["doc_id", "rk1", "rk2"]

    def of(batches):
        for batch in batches:
            sid, n, fp, keys = [], [], [], []
            for text in batch["text"]:
                h = shingle_set(text.as_py(), width)
                x = xxhash.xxh3_64_intdigest(h.tobytes())
                sid.append(x - (1 << 64) if x >> 63 else x)
                n.append(len(h))
                fp.append(bits_of(h))
                keys.append(bands(h))
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), keys], [*names, "sid", "n", "fp", "bands"])

    return of


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _alike(width: int, similarity: float):
    def of(batches):
        known: dict[int, np.ndarray] = {}  # of the last ones met: pairs come with one end in common
        for batch in batches:
            ok = []
            for a, b, text, other in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), unpacked(batch["text"]), unpacked(batch["other"]), strict=True):
                for sid, t in ((a, text), (b, other)):
                    if sid not in known:
                        if len(known) > 64:
                            known.clear()
                        known[sid] = shingle_set(t, width)
                x, y = known.get(a), known.get(b)
                ok.append(jaccard(shingle_set(text, width) if x is None else x, shingle_set(other, width) if y is None else y) >= similarity)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return of


def _sets(width: int):
    """The set of each text, as its hashes."""

    def of(batches):
        for batch in batches:
            for sid, text in zip(batch["sid"], unpacked(batch["text"]), strict=True):
                h = shingle_set(text, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), sid.as_py()), pa.int64()), pa.array(np.full(len(h), len(h)), pa.int32()), pa.array(h.view(np.int64))], ["sid", "n", "k"])

    return of


def _sizes_fit(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def rare_first(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(k, x: sid, n, at) of the texts (sid, text): shingles of a prefix of each set, rare ones
    first. Sets that are alike share one of them, whatever the order is; in this one, what a
    template has in common comes last, and nobody meets there."""
    tokens = texts.mapInArrow(released(_sets(width)), "sid long, n int, k long")
    often = stored(tokens.groupBy("k").agg(F.count("*").alias("often")).filter("often > 1"), "similar-often")
    # shingles of one set only come first, and nobody is met there
    known = tokens.join(often, "k").groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("often", "k"))).alias("known"))
    own = F.col("n") - F.size("known")
    first = F.greatest(F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1 - own, F.lit(0)).cast("int")
    members = known.select("sid", "n", own.alias("own"), F.posexplode(F.slice("known", F.lit(1), first)).alias("at", "t"))
    return members.select(F.col("t.k").alias("k"), F.struct("sid", "n", (F.col("own") + F.col("at")).alias("at")).alias("x"))


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, few: int = 8) -> DataFrame:
    """doc_id, rk1, rk2 and ``label`` as ``near_duplicates`` has them, for documents whose shingle
    sets are alike with ``similarity`` (Jaccard) or more.

    Sets whose SimHash fingerprints are within 3 bits are found by ``sparse_links``. Sets that
    are 0.8 alike differ in some ten bits, so sets also meet in bands of minimum hashes; in
    each band all are paired with the least set there, in a few bands first and then where a band
    still holds several components. All pairs are compared, set with set, and components are
    found. Near copies thus form a star.

    What meets in a band and is still not in one component is compared with each other: in
    bands of at most ``few`` sets directly, and in larger ones (texts of one template) where sets
    share a shingle of their prefixes in the order of ``rare_first``, which loses no pair.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", *row_key("doc_id", "text"), F.col("text").cast("binary").alias("text"))
    fps = stored(rows.mapInArrow(released(_described(width)), "doc_id long, rk1 long, rk2 long, sid long, n int, fp long, bands array<long>"), "similar-fps")
    nodes = stored(fps.groupBy("sid").agg(F.min(_label()).alias("label"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "similar-nodes")
    same = stored(nodes.groupBy("fp").agg(F.min("sid").alias("sid"), F.max("sid").alias("hi")), "similar-codes")
    near = sparse_links(same.select("fp"), same.count()).join(same.select(F.col("fp").alias("a"), F.col("sid").alias("x")), "a").join(same.select(F.col("fp").alias("b"), F.col("sid").alias("y")), "b").select("x", "y")
    near = near.union(nodes.select("fp", F.col("sid").alias("y")).join(same.filter("sid != hi").select("fp", F.col("sid").alias("x")), "fp").filter("x != y").select("x", "y"))
    in_bands = lambda df, of: df.select(*(c for c in df.columns if c != "bands"), F.explode(of).alias("k"))
    some = in_bands(nodes.select("sid", "n", "bands"), F.slice("bands", 1, FIRST_BANDS))
    centres = some.groupBy("k").agg(F.min(F.struct("sid", "n")).alias("c"), F.max("sid").alias("hi")).filter("c.sid != hi").select("k", "c")
    star = some.join(stored(centres, "similar-centres"), "k").filter("sid != c.sid").filter(_sizes_fit(F.col("n"), F.col("c.n"), similarity))
    pairs = star.select(F.col("c.sid").alias("x"), F.col("sid").alias("y")).union(near)
    pairs = stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "similar-pairs")

    def texts_of(sids: DataFrame) -> DataFrame:
        """One text of each of these sets."""
        asked = nodes.select("sid", F.col("label.rk1").alias("rk1"), F.col("label.rk2").alias("rk2")).join(sids.distinct(), "sid", "left_semi")
        return stored(packed(rows.select("rk1", "rk2", "text")).join(asked, ["rk1", "rk2"]).dropDuplicates(["sid"]).select("sid", "text"), "similar-texts")

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("other")), "b").join(texts.withColumnRenamed("sid", "a"), "a")
        return stored(both.select("a", "b", "text", "other").mapInArrow(released(_alike(width, similarity)), "a long, b long"), "similar-links")

    def grouped(df: DataFrame, found: DataFrame) -> DataFrame:
        """``df`` with the component of each sid."""
        of = components(nodes.select(F.col("sid").alias("fp"), F.col("sid").alias("label")), found).select(F.col("fp").alias("sid"), F.col("label").alias("group"))
        return df.join(of, "sid", "left").withColumn("group", F.coalesce("group", "sid"))

    found = verified(pairs, texts_of(pairs.select(F.col("a").alias("sid")).union(pairs.select("b"))))
    every = in_bands(stored(grouped(nodes.select("sid", "n", "bands"), found), "similar-groups"), F.col("bands"))
    mixed = every.groupBy("k").agg(F.min(F.struct("sid", "n", "group")).alias("c"), F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("held")).filter("lo != hi")
    members = stored(every.join(stored(mixed.select("k", "c", "held"), "similar-mixed"), "k"), "similar-members")
    if members.limit(1).count():
        texts = texts_of(members.select("sid"))
        more = members.filter("group != c.group").filter(_sizes_fit(F.col("n"), F.col("c.n"), similarity))
        more = more.select(F.least("sid", "c.sid").alias("a"), F.greatest("sid", "c.sid").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        more = stored(more, "similar-more")
        found, pairs = found.union(verified(more, texts)), pairs.union(more)
        found = found.union(verified(_apart(grouped(members.select("k", "sid", "n", "held"), found), texts, pairs, lambda df: grouped(df, found), width, similarity, few), texts))
    least = components(nodes.select(F.col("sid").alias("fp"), "label"), found).withColumnRenamed("fp", "sid")
    ids = nodes.select("sid", "label").join(least.withColumnRenamed("label", "first"), "sid", "left").select("sid", F.coalesce("first", "label").alias("label"))
    return fps.select("doc_id", "rk1", "rk2", "sid").join(stored(ids, "similar-ids"), "sid")


def _apart(members: DataFrame, texts: DataFrame, pairs: DataFrame, grouped: Callable[[DataFrame], DataFrame], width: int, similarity: float, few: int) -> DataFrame:
    """(a, b) of the ``members`` (k, sid, n, held, group) that meet, are in different components
    and were not among ``pairs``."""
    apart = stored(members, "similar-apart")
    split = stored(apart.groupBy("k").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo != hi").select("k"), "similar-split")
    apart = apart.join(split, "k", "left_semi")
    little = apart.filter(F.col("held") <= few)
    a, b = (little.select("k", F.col("sid").alias(n), F.col("n").alias(f"{n}_n"), F.col("group").alias(f"{n}_group")) for n in "ab")
    rest = a.join(b, "k").filter("a_group < b_group").filter(_sizes_fit(F.col("a_n"), F.col("b_n"), similarity)).select("a", "b")
    crowd = stored(apart.filter(F.col("held") > few).select("sid").distinct(), "similar-crowd")
    if crowd.limit(1).count():
        met = rare_first(texts.join(crowd, "sid", "left_semi"), width, similarity)
        met = stored(grouped(met.select("k", "x", F.col("x.sid").alias("sid"))).select("k", "x", "group"), "similar-met")
        split = stored(met.groupBy("k").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo != hi").select("k"), "similar-met-split")
        a, b = (met.join(split, "k", "left_semi").select("k", F.col("x").alias(n), F.col("group").alias(f"{n}_group")) for n in "ab")
        left = lambda n: F.col(f"{n}.n") - F.col(f"{n}.at")
        enough = F.least(left("a"), left("b")) >= similarity / (1 + similarity) * (F.col("a.n") + F.col("b.n")) - 1e-9
        rest = rest.union(a.join(b, "k").filter("a_group < b_group").filter(_sizes_fit(F.col("a.n"), F.col("b.n"), similarity) & enough).select("a.sid", "b.sid"))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    return stored(rest, "similar-rest")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of similar ones, the first by doc_id; of rows
    that repeat it, one stays. Texts meet the keys of rows that go, nothing else."""
    keyed = docs.select(whole_row(docs).alias("row"), *row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    marked = stored(similar_documents(docs, width, similarity).groupBy("rk1", "rk2").agg(F.count("*").alias("n"), F.first(F.struct("rk1", "rk2") == F.struct("label.rk1", "label.rk2")).alias("stays")), "similar-marks")
    kept = keyed.join(marked.filter("NOT stays").select("rk1", "rk2"), ["rk1", "rk2"], "left_anti")
    if marked.filter("stays AND n > 1").limit(1).count():
        kept = kept.dropDuplicates(["rk1", "rk2"])
    return unfolded(kept, "row", docs.columns)
