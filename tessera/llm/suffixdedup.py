"""Exact removal of long repeated byte strings, by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in the same or
another document. Strings are judged on the input, matches never cross documents.

The suffix array is built by linear grouping construction (``suffix_array``): suffixes are
grouped by their Lyndon prefixes, groups are processed in descending order, each sending its
members' previous-smaller positions to groups of their own; then each group's order is emitted
from that of smaller suffixes. There is no recursion and no renaming.

One array over all text would not distribute, so strings are first brought together:

1. Every window of ``length`` bytes has an anchor, the ``gram`` bytes in it with the least hash
   (the leftmost of equals). Windows with the same anchor occurrence form a run; equal windows
   have equal anchors at equal offsets. Anchors that occur once are done with.
2. Runs of one anchor with the same bytes (by a digest of 128 bits) form a class with a count,
   and one run of each class is fetched.
3. In buckets of anchors, each class goes into a suffix array once, or twice where it counts more
   than one run. Symbols are blocks of 32 bytes, aligned at the anchor. Common prefixes of
   neighbours in the array say which windows can stand elsewhere; of those, the ones of which
   another class has the same bytes do. The bytes are compared, hashes only say with what.
4. An anchor with too many classes for one array (a passage that very many texts go on from in
   their own ways) is not cut off: its windows are dealt by their distance to the anchor into
   narrower runs, with what all windows of such a run have in common as their new anchor, and
   these go through steps 2 and 3 in turn. Narrowed far enough, a run is one window.

Hashes that route are 64 bits of polynomials with a random table; nothing is removed because of
them. Defined results: null text is empty; documents shorter than ``length`` keep all bytes; rows
that repeat are documents of their own, so both lose what is long enough; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, released, small_batches, stored, unpacked

GRAM = 64
#: Bytes of a symbol of the suffix array.
BLOCK = 32
#: Windows of a document that are hashed at a time.
CHUNK = 1 << 18
#: Distances to the anchor that windows of a run have, at each narrowing.
WIDTHS = (48, 6, 1)
_LAST = (1 << 63) - 1
_TABLE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of the suffixes of ``symbols`` (integers) in their order."""
    n = len(symbols) + 1
    if n == 1:
        return []
    text = np.empty(n, np.int64)
    text[:-1] = symbols
    text[-1] = text[:-1].min() - 1  # ends before anything else
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    ends = np.append(heads[1:], n)
    group = np.empty(n, np.int64)  # of each suffix: the first place of its group
    group[order] = np.repeat(heads, ends - heads)
    group = group.tolist()
    order = order.tolist()
    members: list = [None] * n  # by the first place of the group
    end_of, head_at = [0] * n, [0] * (n + 1)  # its end by its first place, and the reverse
    for h, e in zip(heads.tolist(), ends.tolist(), strict=True):
        members[h], end_of[h], head_at[e] = order[h:e], e, h
    before = [-1] * n  # of each suffix: the last position before it of a smaller group

    def leave(old: int, some: list[int]) -> None:
        """Put these suffixes of a group into one of their own, at its upper end."""
        end = end_of[old]
        new = end - len(some)
        if new != old:
            end_of[old], end_of[new] = new, end
            head_at[end], head_at[new] = new, old
            members[new] = some
            for j in some:
                group[j] = new

    at = n
    while at > 0:
        own = head_at[at]
        if at - own == 1:
            for i in members[own]:
                if group[i] == own:
                    j = i - 1
                    while j >= 0 and group[j] >= own:
                        j = before[j]
                    before[i] = j
                    if j >= 0 and end_of[group[j]] - group[j] > 1:
                        leave(group[j], [j])
                    break
            members[own] = None
            at = own
            continue
        # positions that members point back to; they come in rising order, equal ones in a row
        hits: dict[int, list[int]] = {}
        last, times = -1, 0
        for i in members[own]:
            if group[i] != own:
                continue
            j = i - 1
            while j >= 0 and group[j] >= own:
                j = before[j]
            before[i] = j
            if j == last:
                times += 1
                continue
            if last >= 0:
                hits.setdefault(times, []).append(last)
            last, times = j, 1
        if last >= 0:
            hits.setdefault(times, []).append(last)
        members[own] = None
        # those hit more often are larger: they leave their group first, to its upper end
        for times in sorted(hits, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in hits[times]:
                moved.setdefault(group[j], []).append(j)
            for old, some in moved.items():
                leave(old, some)
        at = own

    out = [-1] * n
    out[0] = n - 1
    free = list(range(n))  # next place of the group that starts here
    free[0] = 1
    done = bytearray(n)
    done[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = before[j]
    return out[1:]


def _power(name: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), _BASE if name == "up" else pow(_BASE, -1, 2**64), np.uint64)
        x[0] = 1
        have = _powers[name] = np.multiply.accumulate(x)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(b: np.ndarray) -> np.ndarray:
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * _power("up", len(b)), out=c[1:])
    return c


def spans_hash(c: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
    return _mix((c[stop] - c[start]) * _power("down", len(c))[start])


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window: prefix and suffix minima of blocks."""
    n = len(a)
    x = np.concatenate([a, np.full(-n % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(b: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor position, anchor hash) of each run."""
    windows = len(b) - length + 1
    parts = []
    for at in range(0, max(0, windows), CHUNK):
        part = b[at : min(len(b), at + CHUNK + length - 1)]
        c = prefix_sums(part)
        n = len(part) - gram + 1
        h = spans_hash(c, slice(0, n), slice(gram, gram + n))
        mask = np.uint64((1 << 28) - 1)
        least = _least((h & ~mask) | np.arange(n, dtype=np.uint64), length - gram + 1)
        spot = (least & mask).astype(np.int64)
        cut = np.flatnonzero(np.diff(spot)) + 1
        s, e = np.concatenate([[0], cut]), np.concatenate([cut, [len(spot)]]) - 1
        p = spot[s]
        parts.append((s + at, e + at, p + at, h[p]))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _pairs(digests: list[bytes]) -> np.ndarray:
    """Digests of 128 bits as two columns of signed longs."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _scan(length: int):
    digest = xxhash.xxh3_128_digest

    def of(batches):
        for batch in batches:
            out, size = [], 0
            for d, rk, text in zip(batch["d"].to_pylist(), batch["rk"].to_pylist(), batch["text"], strict=True):
                data = text.as_buffer()
                s, e, p, a = runs(np.frombuffer(data, np.uint8), length)
                data = memoryview(data)
                c = _pairs([digest(data[i:j]) for i, j in zip(s.tolist(), (e + length).tolist(), strict=True)])
                out.append((np.full(len(s), d), np.full(len(s), rk), s.astype(np.int32), e.astype(np.int32), p.astype(np.int32), a.view(np.int64), c[:, 0], c[:, 1]))
                size += len(s)
                if size > 10_000:
                    yield _columns(out)
                    out, size = [], 0
            if out:
                yield _columns(out)

    return of


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["d", "rk", "s", "e", "p", "a", "c1", "c2"])


_CONTEXT = "a long, c1 long, c2 long, n long, rel int, ctx binary"
_CONTEXT_ARROW = pa.schema([("a", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), ("rel", pa.int32()), ("ctx", pa.binary())])


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _fetch(length: int):
    """Bytes of the runs asked for, from the texts that hold them."""

    def of(batches):
        for batch in batches:
            rows, size = [], 0
            for data, wanted in zip(unpacked(batch["text"]), batch["wanted"], strict=True):
                for w in wanted.as_py():
                    ctx = data[w["s"] : w["e"] + length]
                    rows.append((w["a"], w["c1"], w["c2"], w["n"], w["p"] - w["s"], ctx))
                    size += len(ctx) + 50
                    if size > 1 << 20:
                        yield _records(rows, _CONTEXT_ARROW)
                        rows, size = [], 0
            yield _records(rows, _CONTEXT_ARROW)

    return of


_NARROW = _CONTEXT + ", up_a long, up_c1 long, up_c2 long, off int"


def narrower(ctx: bytes, rel: int, width: int, length: int) -> list[tuple[int, int, bytes]]:
    """(first window, last window, what all windows of such a run have in common) of the narrower
    runs: windows whose distances to the anchor are in one range of ``width``."""
    out = []
    most = len(ctx) - length  # the last window
    for g in range((rel - most) // width, rel // width + 1):
        lo, hi = max(0, rel - g * width - width + 1), min(most, rel - g * width)
        out.append((lo, hi, g.to_bytes(4, "little") + ctx[rel - g * width : rel - g * width - width + 1 + length]))
    return out


def _narrow(width: int, length: int):
    schema = pa.schema([*_CONTEXT_ARROW, ("up_a", pa.int64()), ("up_c1", pa.int64()), ("up_c2", pa.int64()), ("off", pa.int32())])

    def of(batches):
        for batch in batches:
            rows, size = [], 0
            for a, c1, c2, n, rel, ctx in zip(*(batch[x].to_pylist() for x in ("a", "c1", "c2", "n", "rel", "ctx")), strict=True):
                for lo, hi, core in narrower(ctx, rel, width, length):
                    part = ctx[lo : hi + length]
                    key = xxhash.xxh3_64_intdigest(core) - (1 << 63)
                    d1, d2 = _pairs([xxhash.xxh3_128_digest(core[:4] + part)])[0].tolist()
                    rows.append((key, d1, d2, n, rel - lo, part, a, c1, c2, lo))
                    size += len(part) + 80
                    if size > 1 << 20:
                        yield _records(rows, schema)
                        rows, size = [], 0
            yield _records(rows, schema)

    return of


def candidate_blocks(contexts: list[bytes], rels: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """For the blocks of all contexts, one after another: how many blocks from there on also
    stand elsewhere (``most`` at most). And where each context's blocks begin."""
    pieces, starts, at = [], [], 0
    for ctx, rel in zip(contexts, rels, strict=True):
        first = rel % BLOCK
        n = (len(ctx) - first) // BLOCK
        pieces.append(ctx[first : first + n * BLOCK])
        starts.append(at)
        at += n + 1
    # ranks, with a symbol of its own after each context
    total = at
    ends = np.append(np.array(starts[1:], np.int64), total) - 1
    inner = np.ones(total, bool)
    inner[ends] = False
    ranks = np.empty(total, np.int64)
    x = np.frombuffer(b"".join(pieces), np.uint64).reshape(-1, BLOCK // 8)
    symbols = np.zeros(len(x), np.uint64)
    for k in range(x.shape[1]):
        symbols = _mix(symbols * np.uint64(_BASE) ^ x[:, k])
    ranks[inner] = np.unique(symbols, return_inverse=True)[1] + len(ends)
    ranks[ends] = np.arange(len(ends))
    order = np.array(suffix_array(ranks.tolist()), np.int64)
    common = np.zeros(total, np.int64)  # with the suffix before it in order
    on = np.arange(1, total)
    for k in range(most):
        left, right = order[on - 1] + k, order[on] + k
        on = on[(left < total) & (right < total)]
        on = on[ranks[order[on - 1] + k] == ranks[order[on] + k]]
        if not len(on):
            break
        common[on] += 1
    reach = np.zeros(total, np.int64)
    reach[order] = common
    reach[order[:-1]] = np.maximum(reach[order[:-1]], common[1:])
    return reach, np.array(starts, np.int64)


def cover(windows: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Maximal runs of bytes that the windows (rising starts) cover."""
    if not len(windows):
        return [], []
    cut = np.flatnonzero(np.diff(windows) > length) + 1
    return windows[np.concatenate([[0], cut])].tolist(), (windows[np.concatenate([cut, [len(windows)]]) - 1] + length).tolist()


def repeated_windows(anchors: list[int], contexts: list[bytes], rels: list[int], counts: list[int], length: int) -> list[np.ndarray]:
    """For classes of runs, all different, the windows that also stand elsewhere. The suffix
    array, in which a class that counts several runs stands twice, says how far each block's
    surroundings repeat; of windows that repeat so far, bytes are compared."""
    twice = [i for i, n in enumerate(counts) for _ in range(2 if n > 1 else 1)]
    reach, starts = candidate_blocks([contexts[i] for i in twice], [rels[i] for i in twice], length // BLOCK)
    place_of = dict(zip(reversed(twice), reversed(starts.tolist()), strict=True))  # the first one of a class
    several = Counter(anchors)
    out = [np.empty(0, np.int64)] * len(contexts)
    owner, window, hashes = [], [], []
    for i, (ctx, rel) in enumerate(zip(contexts, rels, strict=True)):
        w = np.arange(len(ctx) - length + 1)
        first = rel % BLOCK
        block = -((first - w) // BLOCK)  # the first whole block at or after the window's start
        lead = first + block * BLOCK - w
        w = w[reach[place_of[i] + block] >= (length - lead) // BLOCK]
        if counts[i] > 1:
            out[i] = w  # the array holds the same bytes twice
        if several[anchors[i]] > 1 and len(w):
            c = prefix_sums(np.frombuffer(ctx, np.uint8))
            owner.append(np.full(len(w), i))
            window.append(w)
            hashes.append(spans_hash(c, w, w + length))
    if not owner:
        return out
    owner, window, hashes = map(np.concatenate, (owner, window, hashes))
    place = np.array(anchors, np.int64).view(np.uint64)[owner] + _mix((np.array(rels)[owner] - window).astype(np.uint64) + np.uint64(1))
    _, first, back = np.unique(_mix(place) ^ hashes, return_index=True, return_inverse=True)
    same = np.flatnonzero(first[back] != np.arange(len(back)))  # stands for the same as an earlier one, if bytes agree
    if not len(same):
        return out
    other = first[back[same]]
    # neighbours that go along with neighbours are compared in one piece
    step = (np.diff(owner[same]) != 0) | (np.diff(window[same]) != 1) | (np.diff(owner[other]) != 0) | (np.diff(window[other]) != 1)
    cut = np.flatnonzero(step) + 1
    hit = np.zeros(len(back), bool)
    doubt = set()
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(same)], strict=True):
        i, j, n = same[lo], other[lo], hi - lo - 1 + length
        if contexts[owner[i]][window[i] : window[i] + n] == contexts[owner[j]][window[j] : window[j] + n]:
            hit[same[lo:hi]] = hit[other[lo:hi]] = True
        else:
            doubt.update(back[same[lo:hi]].tolist())
    for k in doubt:  # different bytes under one hash: each is looked up among those
        of = np.flatnonzero(back == k).tolist()
        bytes_of = [contexts[owner[t]][window[t] : window[t] + length] for t in of]
        n = Counter(bytes_of)
        for t, x in zip(of, bytes_of, strict=True):
            hit[t] = n[x] > 1
    owner, window = owner[hit], window[hit]
    cut = np.flatnonzero(np.diff(owner)) + 1
    for i, w in zip(owner[np.concatenate([[0], cut])] if len(owner) else [], np.split(window, cut), strict=False):
        if counts[i] == 1:
            out[i] = w
    return out


_VERDICT = "a long, c1 long, c2 long, lo array<int>, hi array<int>"


def _bucket(length: int):
    schema = pa.schema([("a", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])

    def of(table: pa.Table) -> pa.Table:
        rows = {(a, c1, c2): x for a, c1, c2, *x in zip(*(table[c].to_pylist() for c in ("a", "c1", "c2", "ctx", "rel", "n")), strict=True)}  # rows that repeat answer twice
        found = repeated_windows([a for a, _, _ in rows], *([x[i] for x in rows.values()] for i in range(3)), length)
        out = [(*k, *cover(w, length)) for k, w in zip(rows, found, strict=True) if len(w)]
        return pa.Table.from_batches([_records(out, schema)])

    return of


def _decided(contexts: DataFrame, length: int, bucket_classes: int, widths: tuple[int, ...]) -> DataFrame:
    """(a, c1, c2, lo, hi): what repeats of each class of ``contexts`` (a stored table)."""
    sizes = stored(contexts.groupBy("a").agg(F.count("*").alias("k")), "repeats-anchors")
    total = sizes.agg(F.sum("k")).first()[0] or 0
    buckets = max(1, -(-total // bucket_classes))
    hot = sizes.filter(F.col("k") > bucket_classes // 2).select("a") if widths else sizes.filter("false").select("a")
    some = widths and hot.limit(1).count() > 0
    here = contexts.join(hot, "a", "left_anti") if some else contexts
    part = here.withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(buckets))).groupBy("bucket").applyInArrow(_bucket(length), _VERDICT)
    if not some:
        return part
    narrow = stored(contexts.join(hot, "a", "left_semi").mapInArrow(released(_narrow(widths[0], length)), _NARROW), "repeats-narrow")
    key = ["a", "c1", "c2"]
    merged = narrow.groupBy(*key).agg(F.sum("n").alias("n"), F.first("rel").alias("rel"), F.first("ctx").alias("ctx"))
    # what stands once under its anchor repeats nowhere
    alone = merged.groupBy("a").agg(F.sum("n").alias("all")).filter("all > 1").select("a")
    merged = stored(merged.join(alone, "a", "left_semi"), "repeats-merged")
    inner = _decided(merged, length, bucket_classes, widths[1:])
    shift = lambda c: F.transform(c, lambda x: x + F.col("off"))
    up = narrow.select(*key, "off", "up_a", "up_c1", "up_c2").join(inner, key).groupBy("up_a", "up_c1", "up_c2").agg(F.flatten(F.collect_list(shift("lo"))).alias("lo"), F.flatten(F.collect_list(shift("hi"))).alias("hi"))
    return part.unionByName(up.select(*(F.col(f"up_{k}").alias(k) for k in key), "lo", "hi"))


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(_LAST)).alias("d"), F.xxhash64(doc_id, text).alias("rk"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))


def repeats(docs: DataFrame, length: int = 400, bucket_classes: int = 2000) -> DataFrame:
    """(d, rk, spans): byte spans to remove of each row that has any, not yet merged; d is doc_id
    (null: the largest long), rk a hash of the row.

    All joins here grow with the input on both sides, and shuffle."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs).select("d", "rk", "text")
    key = ["a", "c1", "c2"]
    found = stored(keyed.filter(F.octet_length("text") >= length).mapInArrow(released(_scan(length)), "d long, rk long, s int, e int, p int, a long, c1 long, c2 long"), "repeats-runs")
    # a stored side of its own lets a join split a hot key of the other
    often = stored(found.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "repeats-often")
    classes = found.join(often, "a", "left_semi").groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("d", "rk", "s", "e", "p")).alias("one"))
    asked = classes.select("one", F.struct(*key, "n", F.col("one.s").alias("s"), F.col("one.e").alias("e"), F.col("one.p").alias("p")).alias("w"))
    asked = asked.groupBy(F.col("one.d").alias("d"), F.col("one.rk").alias("rk")).agg(F.collect_list("w").alias("wanted"))
    contexts = stored(packed(keyed).join(asked, ["d", "rk"]).mapInArrow(released(_fetch(length)), _CONTEXT), "repeats-contexts")
    verdict = _decided(contexts, length, bucket_classes, WIDTHS)
    gone = found.select(*key, "d", "rk", "s").join(verdict, key)
    spans = F.transform(F.arrays_zip("lo", "hi"), lambda x: F.struct((x["lo"] + F.col("s")).alias("lo"), (x["hi"] + F.col("s")).alias("hi")))
    return gone.select("d", "rk", spans.alias("spans")).groupBy("d", "rk").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def _apply(batches):
    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
    for batch in batches:
        rows = []
        for doc_id, data, spans in zip(batch["doc_id"].to_pylist(), unpacked(batch["text"]), batch["spans"].to_pylist(), strict=True):
            cuts = merge(spans)
            edges = [0, *(x for cut in cuts for x in cut), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((doc_id, len(data), len(data) - len(kept), len(cuts), kept))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * 5, names, strict=True)], [n for n, _ in names])


def remove_repeats(docs: DataFrame, length: int = 400, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` are the remaining bytes."""
    joined = packed(_keyed(docs)).join(repeats(docs, length, **options), ["d", "rk"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(released(_apply), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame, length: int = 400, **options) -> DataFrame:
    done = remove_repeats(docs, length, **options)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def plain_removed(texts: list[bytes], length: int) -> list[bytes]:
    """What stays, by a table of all strings: for small tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            k = hashlib.blake2b(t[i : i + length]).digest()
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[hashlib.blake2b(t[i : i + length]).digest()] > 1:
                gone[i : i + length] = b"\x01" * length
        out.append(bytes(x for x, g in zip(t, gone, strict=True) if not g))
    return out
