"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest permitted length, so nothing is truncated.
Pieces are placed longest first into the open bin that they fill best; where none has room, a
bin of the least-cost permitted length that holds the piece is opened. In the end each bin is
downsized to the smallest permitted length that holds its contents.

Which length to open for a piece is decided for all lengths jointly: a plan says for every piece
length what is opened for it, the pieces are packed by it, and the plan with the least cost over
all bins stays. Plans are each single length (longer ones where a piece needs it), the least
length that holds the piece, and, in rounds, the length of the least expected cost per token,
where the share of the space beside a piece that gets filled is the one measured in the round
before. Bins that stay poorly filled are then packed anew among themselves, as long as that
lowers the cost. So the number of bins of each length is a result. The cost of a bin is its length
and ``overhead``, or what ``cost`` says.

Documents are dealt into shards by a hash of doc_id, row content and copy; each shard packs on its
own and holds about ``shard_tokens`` tokens, whatever the input size. Rows that repeat are counted
before they are shuffled.

Defined results: a document without words gives no piece; repeated rows are packed one by one;
null doc_id is carried; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import size_in_words, small_batches, stored

CAPACITIES = (512, 1024, 2048, 4096)
#: Rounds of measuring how space gets filled, and of packing poorly filled bins anew.
ROUNDS = 4


def cut(length: int, most: int) -> list[int]:
    """Lengths of the pieces of a document: full ones, then what remains."""
    return [most] * (length // most) + ([length % most] if length % most else [])


class Bins:
    """Open bins by free space, which is an integer below the largest length: a bit mask finds
    the smallest space that is large enough."""

    def __init__(self) -> None:
        self.free: dict[int, list[int]] = {}
        self.mask = 0

    def put(self, space: int, bin_no: int) -> None:
        if space > 0:
            self.free.setdefault(space, []).append(bin_no)
            self.mask |= 1 << space

    def take(self, least: int) -> tuple[int, int] | None:
        rest = self.mask >> least
        if not rest:
            return None
        space = least + (rest & -rest).bit_length() - 1
        found = self.free[space].pop()
        if not self.free[space]:
            self.mask ^= 1 << space
        return space, found


Bin = tuple[int, list[int]]  # length, positions of its pieces


def best_fit(order: list[int], pieces: list[int], opens: list[int]) -> list[Bin]:
    """Pieces (positions in ``order``) each go to the open bin that they fill best, or open one
    of the length that ``opens`` has for a piece of their size."""
    bins, out = Bins(), []
    for i in order:
        size = pieces[i]
        found = bins.take(size)
        if found is None:
            found = opens[size], len(out)
            out.append((opens[size], []))
        space, no = found
        out[no][1].append(i)
        bins.put(space - size, no)
    return out


def _plans(capacities: tuple[int, ...]) -> list[list[int]]:
    least = [capacities[bisect_left(capacities, p)] for p in range(capacities[-1] + 1)]
    return [[max(c, x) for x in least] for c in capacities]  # the first of them is the least length that holds it


def _measured(bins: list[Bin], pieces: list[int]) -> dict[int, float]:
    """By the top bits of the space beside the first piece of a bin: the share that got filled."""
    room, held = defaultdict(int), defaultdict(int)
    for length, inside in bins:
        space = length - pieces[inside[0]]
        room[space.bit_length()] += space
        held[space.bit_length()] += sum(pieces[i] for i in inside[1:])
    return {k: held[k] / room[k] for k in room if room[k]}


def optimise(pieces: list[int], order: list[int], capacities: tuple[int, ...], cost: Callable[[int], float]) -> list[Bin]:
    """Bins, already downsized, of the plan that costs least."""

    def downsized(bins: list[Bin]) -> list[Bin]:
        return [(capacities[bisect_left(capacities, sum(pieces[i] for i in inside))], inside) for _, inside in bins]

    def total(bins: list[Bin]) -> float:
        return sum(cost(length) for length, _ in bins)

    best, share = None, {}
    for opens in _plans(capacities):
        bins = best_fit(order, pieces, opens)
        share = {k: max(v, share.get(k, 0.0)) for k, v in _measured(bins, pieces).items()} | {k: v for k, v in share.items() if k not in _measured(bins, pieces)}
        bins = downsized(bins)
        if best is None or total(bins) < total(best):
            best = bins
    tried = set()
    for _ in range(ROUNDS):
        price = lambda p, c: cost(c) / (p + (c - p) * share.get((c - p).bit_length(), 1.0))
        opens = [min((c for c in capacities if c >= p), key=lambda c: (price(max(p, 1), c), c)) for p in range(capacities[-1] + 1)]
        if tuple(opens) in tried:
            break
        tried.add(tuple(opens))
        bins = best_fit(order, pieces, opens)
        share |= _measured(bins, pieces)
        bins = downsized(bins)
        if total(bins) < total(best):
            best = bins
    return best


def pack(pieces: Iterable[int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = 8.0, cost: Callable[[int], float] | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, start within it) of each piece, in the order given, and the final length of each bin."""
    pieces = list(pieces)
    capacities = tuple(sorted(capacities))
    cost = cost or (lambda length: length + overhead)
    order = sorted(range(len(pieces)), key=lambda i: (-pieces[i], i))
    if not pieces:
        return [], []
    bins = optimise(pieces, order, capacities, cost)
    for _ in range(ROUNDS):
        used = lambda b: sum(pieces[i] for i in b[1])
        poor = [b for b in bins if used(b) < 0.9 * b[0]]
        again = optimise(pieces, sorted((i for _, inside in poor for i in inside), key=lambda i: (-pieces[i], i)), capacities, cost) if poor else []
        if sum(cost(c) for c, _ in again) >= sum(cost(c) for c, _ in poor):
            break
        bins = [b for b in bins if used(b) >= 0.9 * b[0]] + again
    placed: list[tuple[int, int]] = [(0, 0)] * len(pieces)
    for no, (_, inside) in enumerate(bins):
        at = 0
        for i in inside:
            placed[i] = no, at
            at += pieces[i]
    return placed, [length for length, _ in bins]


_OUT = "doc_id long, piece int, piece_start long, n_tokens long, shard int, bin int, bin_start long, capacity int"


def _packer(capacities: tuple[int, ...], overhead: float, cost: Callable[[int], float] | None):
    most = capacities[-1]

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("tie", "ascending"), ("copy", "ascending")])
        cuts = [cut(x, most) for x in rows["size"].to_pylist()]
        pieces = [p for c in cuts for p in c]
        owner = pa.array([i for i, c in enumerate(cuts) for _ in c], pa.int64())
        numbers = [n for c in cuts for n in range(len(c))]
        placed, lengths = pack(pieces, capacities, overhead, cost)
        return pa.table({
            "doc_id": rows["doc_id"].take(owner), "piece": pa.array(numbers, pa.int32()), "piece_start": pc.multiply(pa.array(numbers, pa.int64()), most), "n_tokens": pa.array(pieces, pa.int64()),
            "shard": pa.array([key[0].as_py()] * len(pieces), pa.int32()), "bin": pa.array([b for b, _ in placed], pa.int32()), "bin_start": pa.array([s for _, s in placed], pa.int64()),
            "capacity": pa.array([lengths[b] for b, _ in placed], pa.int32()),
        })

    return packed


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: float = 8.0, shard_tokens: int = 4_000_000, size: Callable[[Column], Column] = size_in_words, cost: Callable[[int], float] | None = None) -> DataFrame:
    """One row per piece: where it starts in its document, its bin (``shard``, ``bin``), where it
    starts there, and the length that the bin was downsized to. Words are counted once; only ids
    and sizes are shuffled."""
    capacities = tuple(sorted(capacities))
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("tie"))
    rows = stored(rows.groupBy("doc_id", "size", "tie").agg(F.count("*").alias("n")).filter("size > 0"), "packing-sizes")
    total = rows.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    rows = rows.select("doc_id", "size", "tie", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie", "copy"), F.lit(shards)).cast("int"))
    return rows.groupBy("shard").applyInArrow(_packer(capacities, overhead, cost), _OUT)
