"""Near-duplicate lines by a deletion-neighbourhood join.

Lines of at least ``min_words`` words are compared by their words (white space runs count as
one). Two lines are near if at most one word was inserted, deleted or replaced. A line goes if it
is equal or near to an earlier one, in the order of doc_id, content of the row, line number.

Every line emits the variants that lack one word as hashed keys: with the place of the gap (lines
that meet there differ in that word only), and without it (lines that meet the unchanged line
there lack one word of it). The hash of a variant is made from those of the line's beginning and
end, so a line of n words costs n steps. Each key knows its earliest line; the edit distance
between a line and that one is verified on their words.

A lossless filter goes first: two near lines agree on their first or on their second half, so a
line that shares no half with another line emits nothing, and one that does emits only variants
with the gap in the other half. Equal lines are one class from the start, so copies never form
pairs, and keys are only ever aggregated, never paired within.

Lines of fewer words, but at least ``equal_words``, are compared too, for equality only; op8 and the
pipeline compare all that are not blank (1). The default is to leave them.

Defined results: null text stays null; shorter and blank lines stay; rows that repeat in all of doc_id and
text are treated alike, as one; documents keep their remaining lines in order; a document may end
up empty; other columns come back as they are, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm.common import packed, released, small_batches, stored, unfolded, unpacked, whole_row

_LAST = (1 << 63) - 1
_h = xxhash.xxh3_64_digest
#: Hashes of word sequences are polynomials modulo this prime, one for each base.
_PRIME = (1 << 31) - 1
_BASES = (1_103_515_245, 1_845_124_763)
#: Words whose variants are made at a time; a longer line goes alone.
_TOGETHER = 20_000
_powers: dict[int, np.ndarray] = {}


def line_words(line: bytes) -> list[bytes]:
    return line.split()


def half_keys(words: list[bytes], line: bytes) -> list[bytes]:
    """Hashes of both halves, cut as a line of as many words is, and as one of a word fewer.
    ``line``: the words with one blank between."""
    n = len(words)
    if n < 4:
        halves = [b" ".join(x) for base in (n, n - 1) for x in (words[: base // 2], words[n - (base - base // 2) :])]
    else:
        cut = n // 2
        first = b" ".join(words[:cut])
        second = line[len(first) + 1 :]
        if n % 2:
            halves = [first, second, first, second[len(words[cut]) + 1 :]]
        else:
            halves = [first, second, first[: -len(words[cut - 1]) - 1], second]
    return [_h(x, seed) for x, seed in zip(halves, (4 * n, 4 * n + 1, 4 * n - 4, 4 * n - 3), strict=True)]


def near(a: list[bytes], b: list[bytes]) -> bool:
    """Whether at most one word was inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, 4096), np.uint64)
        done = 1
        while done < len(out):  # twice as many each time
            more = min(done, len(out) - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, _PRIME)) % np.uint64(_PRIME)
            done += more
        have = _powers[base] = out
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def variants(lines: list[list[bytes]], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line number, role, key): role 0 for a gap with its place, 1 for one without, 2 for the
    line itself. ``halves``: bit j is set if key j of ``half_keys`` is shared; gaps are needed
    where the other half differs."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    start = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(lines)), n)
    place = np.arange(len(owner)) - start[owner]
    word = np.frombuffer(b"".join([_h(w) for line in lines for w in line]), ">u8").astype(np.uint64)
    prime = np.uint64(_PRIME)
    whole, gap = np.zeros(len(lines), np.uint64), np.zeros(len(owner), np.uint64)
    for base, part in zip(_BASES, (word >> np.uint64(32), word & np.uint64(0xFFFFFFFF)), strict=True):
        upto = np.zeros(len(owner) + 1, np.uint64)
        np.cumsum(part % prime * _power(base, int(n.max(initial=0)))[place] % prime, out=upto[1:])
        before = (upto[:-1] - upto[start[owner]]) % prime
        total = (upto[start + n] - upto[start]) % prime
        after = (upto[(start + n)[owner]] - upto[1:]) % prime
        back = np.uint64(pow(base, -1, _PRIME))
        whole = whole << np.uint64(31) | total
        gap = gap << np.uint64(31) | (before + after * back) % prime
    length = n.astype(np.uint64)
    whole = _mix(whole ^ _mix(length + np.uint64(1)))
    gap = _mix(gap ^ _mix(length[owner]))  # of one word less
    bits = halves[owner]
    placed = (bits & np.where(place >= (n // 2)[owner], 1, 2)) > 0  # a line of as many words: replaced here
    lacking = (bits & np.where(place >= ((n - 1) // 2)[owner], 4, 8)) > 0  # a line of a word fewer lacks this one
    keys = [_mix(gap[placed] + np.uint64(2) * place[placed].astype(np.uint64) + np.uint64(1)), gap[lacking], whole]
    owners = [owner[placed], owner[lacking], np.arange(len(lines))]
    return np.concatenate(owners), np.repeat(np.arange(3, dtype=np.int8), list(map(len, keys))), np.concatenate(keys).view(np.int64)


_SCAN = "d long, rk long, line int, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long"


def _scan(min_words: int, equal_words: int):
    def batch_of(d, rk, no, digests, halves, long):
        pairs = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        known = np.zeros((len(no), 4), np.int64)
        mask = np.array(long, bool)
        known[mask] = np.frombuffer(b"".join(halves), ">i8").astype(np.int64).reshape(-1, 4)
        columns = [pa.array(d, pa.int64()), pa.array(rk, pa.int64()), pa.array(no, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(pa.array(known[:, j], mask=~mask) for j in range(4))]
        return pa.RecordBatch.from_arrays(columns, ["d", "rk", "line", "h1", "h2", "k0", "k1", "k2", "k3"])

    def of(batches):
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for own, rk, text in zip(batch["d"].to_pylist(), batch["rk"].to_pylist(), batch["text"], strict=True):
                for no, line in enumerate((text.as_py() or b"").split(b"\n")):
                    words = line.split()
                    if len(words) >= equal_words:
                        line = b" ".join(words)
                        for column, x in zip(rows, (own, rk, no, xxhash.xxh3_128_digest(line)), strict=False):
                            column.append(x)
                        rows[5].append(len(words) >= min_words)
                        if rows[5][-1]:
                            rows[4].extend(half_keys(words, line))
                if len(rows[0]) > 10_000:
                    yield batch_of(*rows)
                    rows = ([], [], [], [], [], [])
            yield batch_of(*rows)

    return of


def _fetch(batches):
    """Words of the lines asked for, from the texts that hold them."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("halves", pa.int32()), ("d", pa.int64()), ("rk", pa.int64()), ("line", pa.int32()), ("words", pa.binary())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    for batch in batches:
        rows, size = [], 0
        for d, rk, text, wanted in zip(batch["d"], batch["rk"], unpacked(batch["text"]), batch["wanted"], strict=True):
            lines = (text or b"").split(b"\n")
            for w in wanted.as_py():
                words = b" ".join(lines[w["line"]].split())
                rows.append((w["h1"], w["h2"], w["halves"], d.as_py(), rk.as_py(), w["line"], words))
                size += len(words) + 50
            if size > 1 << 20:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)


def _variants(batches):
    for batch in batches:
        lines = [w.split(b" ") for w in batch["words"].to_pylist()]
        halves = batch["halves"].to_numpy(zero_copy_only=False)
        at = 0
        while at < len(lines):
            end, size = at, 0
            while end < len(lines) and (end == at or size + len(lines[end]) <= _TOGETHER):
                size += len(lines[end])
                end += 1
            owner, role, key = variants(lines[at:end], halves[at:end])
            own = pa.array(owner + at)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), *(batch[c].take(own) for c in ("d", "rk", "line", "h1", "h2"))], ["key", "role", "d", "rk", "line", "h1", "h2"])
            at = end


def _verify(batches):
    for batch in batches:
        ok = [near(a.split(b" "), b.split(b" ")) for a, b in zip(batch["words"].to_pylist(), batch["other"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["h1"], batch["h2"]], ["h1", "h2"]).filter(pa.array(ok, pa.bool_()))


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.coalesce(doc_id, F.lit(_LAST)).alias("d"), F.xxhash64(doc_id, text).alias("rk"), text.cast("binary").alias("text"))


def removed_lines(docs: DataFrame, min_words: int = 5, equal_words: int | None = None) -> DataFrame:
    """(d, rk, gone): the line numbers to remove of each row that loses any, where d is doc_id
    (null: the largest long) and rk a hash of the row.

    All joins here grow with the input on both sides, and shuffle."""
    keyed = _keyed(docs)
    small_batches(docs.sparkSession)
    lines = stored(keyed.mapInArrow(released(_scan(min_words, min_words if equal_words is None else min(max(equal_words, 1), min_words))), _SCAN), "lines")
    keys = ["k0", "k1", "k2", "k3"]
    place = F.struct("d", "rk", "line")
    classes = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), *(F.min(k).alias(k) for k in keys))
    classes = stored(classes, "lines-classes")
    # a line is alone in a key if the least and the greatest line there are the same
    each = classes.select("h1", F.explode(F.array(*keys)).alias("k")).filter("k IS NOT NULL")  # short lines have no halves
    shared = stored(each.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo != hi").select("k"), "lines-halves")
    tagged = classes.select("h1", "h2", F.posexplode(F.array(*keys)).alias("at", "k")).filter("k IS NOT NULL").join(shared, "k", "left_semi")
    alive = tagged.groupBy("h1", "h2").agg(F.expr("bit_or(shiftleft(1, at))").alias("halves")).join(classes.select("h1", "h2", "first"), ["h1", "h2"])
    asked = alive.groupBy(F.col("first.d").alias("d"), F.col("first.rk").alias("rk")).agg(F.collect_list(F.struct("h1", "h2", "halves", F.col("first.line").alias("line"))).alias("wanted"))
    # rows that repeat would answer twice
    held = packed(keyed).join(asked, ["d", "rk"]).mapInArrow(released(_fetch), "h1 long, h2 long, halves int, d long, rk long, line int, words binary").dropDuplicates(["h1", "h2"])
    held = stored(held, "lines-held")
    emitted = held.mapInArrow(released(_variants), "key long, role byte, d long, rk long, line int, h1 long, h2 long").withColumn("place", F.struct("d", "rk", "line", "h1", "h2")).select("key", "role", "place")
    # per key: the earliest line of each role. A gap with its place answers to another such gap,
    # a gap without to the line itself, and that line to the earliest such gap.
    best = lambda role: F.min(F.when(F.col("role") == role, F.col("place"))).alias(f"r{role}")
    first = emitted.groupBy("key").agg(best(0), best(1), best(2), F.count("*").alias("n")).filter("n > 1 AND (r0 IS NOT NULL OR (r1 IS NOT NULL AND r2 IS NOT NULL))").drop("n")
    met = emitted.join(stored(first, "lines-first"), "key").withColumn("other", F.when(F.col("role") == 0, F.col("r0")).when(F.col("role") == 1, F.col("r2")).otherwise(F.col("r1")))
    pairs = met.filter("other < place").groupBy("place.h1", "place.h2").agg(F.min("other").alias("other"))
    words = held.select("h1", "h2", "words")
    pairs = pairs.join(words, ["h1", "h2"]).select("h1", "h2", "words", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"))
    other = words.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("words").alias("other"))
    near_ones = pairs.join(other, ["o1", "o2"]).select("h1", "h2", "words", "other").mapInArrow(released(_verify), "h1 long, h2 long")
    near_ones = near_ones.withColumn("near", F.lit(True))
    # of a class: all but the first occurrence go, and the first too if it is near an earlier line
    fate = classes.select("h1", "h2", "first", "n").join(near_ones, ["h1", "h2"], "left").filter("n > 1 OR near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("d", "rk", "line", "h1", "h2").join(stored(fate, "lines-fate"), ["h1", "h2"]).filter(F.col("near") | (F.struct("d", "rk", "line") != F.col("first")))
    return gone.groupBy("d", "rk").agg(F.collect_set("line").alias("gone"))


def _rebuild(batches):
    for batch in batches:
        texts, total, lost = [], [], []
        for text, gone in zip(unpacked(batch["text"]), batch["gone"], strict=True):
            lines = [] if text is None else text.split(b"\n")
            out = set(gone.as_py() or ())
            if out:
                text = b"\n".join(x for i, x in enumerate(lines) if i not in out)
            texts.append(None if text is None else text.decode())
            total.append(len(lines))
            lost.append(len(out))
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())], ["row", "text", "n_lines", "n_removed"])


def _deduplicated(docs: DataFrame, min_words: int, equal_words: int | None) -> DataFrame:
    """``row`` (all columns but the text), ``text`` without the lines that go, ``n_lines, n_removed``."""
    gone = removed_lines(docs, min_words, equal_words)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(whole_row(docs, "text").alias("row"), text.alias("text"), F.coalesce(doc_id, F.lit(_LAST)).alias("d"), F.xxhash64(doc_id, text).alias("rk"))
    rows = packed(rows).join(gone, ["d", "rk"], "left").select("row", "text", "gone")
    schema = StructType([rows.schema["row"], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    return rows.mapInArrow(released(_rebuild), schema)


def dedup_lines(docs: DataFrame, min_words: int = 5, equal_words: int | None = None) -> DataFrame:
    """``docs`` without near-duplicate lines."""
    return unfolded(_deduplicated(docs, min_words, equal_words), "row", docs.columns, text=F.col("text"))


def line_report(docs: DataFrame, min_words: int = 5, equal_words: int | None = None) -> DataFrame:
    """doc_id, text (what remains), n_lines and n_removed of each document."""
    return _deduplicated(docs.select("doc_id", "text"), min_words, equal_words).select("row.doc_id", "text", "n_lines", "n_removed")
