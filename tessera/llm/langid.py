"""Language identification with a linear-chain conditional random field over words.

Each word has features of its own letters: prefixes and suffixes of 1 to 4 letters, bigrams and
trigrams with word ends, and itself if it is in the learned lexicon. Feature weights and the
transitions between languages are learned; forward-backward gives each word's probability of
each language, so a text that switches language is labelled word by word. A document's language
is the one with the largest expected share of its words, and the score is that share.

Learning takes two rounds on a bounded sample (``sample_docs`` documents of each language, with
at most ``sample_chars`` characters each; longer documents are sampled where a language has no
others). Every labelled language is learned. Round 1
gives every word its document's label and learns feature weights only. Round 2 relabels the
words by forward-backward with sticky transitions, so that passages in another language get
their own label, and learns weights and transitions.

Forward-backward runs over whole texts: words are cut into blocks, the transfer matrix of each
block is multiplied up, block borders are chained, and the blocks are then filled in, all in
arrays over many blocks at once; the result is that of the plain recursion.

Defined results: null text, or text without a letter, is ``und`` with score 0; without any
labelled row to learn from, everything is ``und``; rows that repeat get equal results; an empty
table gives no rows.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import released, small_batches

#: A run of letters: word characters but digits and the underscore.
WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
UNKNOWN = "und"
#: Words of a block in forward-backward.
BLOCK = 32
#: Words whose scores a worker keeps before it starts afresh.
CACHE = 200_000
#: Words whose features are made at a time.
SCORED = 4096
#: Letters of the texts that are labelled at a time; a longer text goes alone.
TOGETHER = 200_000
#: Texts in the sample of a language that has long ones only.
LONG_DOCS = 4
#: Bytes of a model that go to the driver in one value.
PIECE = 1 << 20


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the words with their ends (1 before, 2 after), and where each word starts."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate([[0], np.cumsum(lengths)])
    text = "".join("\x01" + w + "\x02" for w in words)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), starts


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(40)).astype(np.int64) % BUCKETS


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature number) pairs. Lexicon words have numbers from BUCKETS on."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c, starts = _codes(words)
    c = c.astype(np.uint64)
    n, owner = len(c), np.repeat(np.arange(len(words)), np.diff(starts))
    who, what = [], []
    two = c[:-1] << np.uint64(21) | c[1:]
    own = owner[:-1] == owner[1:]
    who.append(owner[:-1][own])
    what.append(_mix(two[own], 1))
    if n > 2:
        three = c[:-2] << np.uint64(42) | two[1:]
        own = owner[:-2] == owner[2:]
        who.append(owner[:-2][own])
        what.append(_mix(three[own], 2))
    first, last, size = starts[:-1], starts[1:] - 1, np.diff(starts) - 2
    number = np.arange(len(words))
    with np.errstate(over="ignore"):
        pre = np.zeros(len(words), np.uint64)
        suf = np.zeros(len(words), np.uint64)
        for k in range(1, 5):
            has = size >= k
            pre[has] = pre[has] * np.uint64(0x100000001B3) + c[first[has] + k]
            suf[has] = suf[has] * np.uint64(0x100000001B3) + c[last[has] - k]
            who += [number[has], number[has]]
            what += [_mix(pre[has], 10 + k), _mix(suf[has], 20 + k)]
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    who.append(number[known >= 0])
    what.append(BUCKETS + known[known >= 0])
    return np.concatenate(who), np.concatenate(what)


def _sum_by(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], axis=1)


def posteriors(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over sequences that lie one after another in ``emit`` (log scores, words
    by labels), none of length 0. Returns each word's label probabilities and, with ``pairs``,
    the expected number of each transition."""
    k = emit.shape[1]
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    # scatter words to (block, place); places beyond a sequence's end act as identity
    total = first[-1]
    grid, real = np.ones((total, BLOCK, k)), np.zeros((total, BLOCK), bool)
    offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    pos = np.arange(len(e)) - np.repeat(offsets, lengths)
    at = (np.repeat(first[:-1], lengths) + pos // BLOCK, pos % BLOCK)
    grid[at] = e
    real[at] = True
    head = np.zeros(total, bool)
    head[first[:-1]] = True
    t, s0 = np.exp(trans), np.exp(start - start.max())
    s0 = s0 / s0.sum()

    def step(state: np.ndarray, j: int) -> np.ndarray:
        """Row vectors (blocks, m, k) moved over place j."""
        moved = state @ t
        if j == 0:
            moved = np.where(head[:, None, None], state, moved)
        moved = moved * grid[:, None, j, :]
        moved /= moved.sum(axis=(1, 2), keepdims=True)
        return np.where(real[:, j, None, None], moved, state)

    # 1. transfer matrix of each block
    m = np.broadcast_to(np.eye(k), (total, k, k))
    for j in range(BLOCK):
        m = step(m, j)
    # 2. chain the borders: what enters each block from the left and from the right
    enter, leave = np.empty((total, k)), np.empty((total, k))
    depth = blocks.max() if len(blocks) else 0
    left, right = np.tile(s0, (len(blocks), 1)), np.ones((len(blocks), k))
    for d in range(depth):
        on = np.flatnonzero(blocks > d)
        b = first[on] + d
        enter[b] = left[on]
        x = np.einsum("nk,nkl->nl", left[on], m[b])
        left[on] = x / x.sum(axis=1, keepdims=True)
        b = first[on] + blocks[on] - 1 - d
        leave[b] = right[on]
        x = np.einsum("nkl,nl->nk", m[b], right[on])
        right[on] = x / x.sum(axis=1, keepdims=True)
    # 3. fill in the blocks
    alpha = np.empty_like(grid)
    state = enter[:, None, :]
    for j in range(BLOCK):
        state = step(state, j)
        alpha[:, j] = state[:, 0]
    beta = np.empty_like(grid)
    back = leave
    counts = np.zeros((k, k)) if pairs else None
    for j in range(BLOCK - 1, -1, -1):
        beta[:, j] = back
        x = grid[:, j] * back
        if pairs:
            prev = enter if j == 0 else alpha[:, j - 1]
            on = real[:, j] & ~(head if j == 0 else np.zeros(total, bool))
            p = prev[on][:, :, None] * t[None] * x[on][:, None, :]
            counts += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        moved = x @ t.T
        moved /= moved.sum(axis=1, keepdims=True)
        back = np.where(real[:, j, None], moved, back)
    gamma = (alpha * beta)[at]
    return gamma / gamma.sum(axis=1, keepdims=True), counts


@dataclass
class Crf:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # features by labels
    trans: np.ndarray
    start: np.ndarray
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)  # of the words in the cache

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of the words, some at a time: their features take many times the room."""
        out = np.empty((len(words), len(self.labels)))
        for at in range(0, len(words), SCORED):
            who, what = features(words[at : at + SCORED], self.lexicon)
            out[at : at + SCORED] = _sum_by(who, self.weights[what], len(words[at : at + SCORED]))
        return out

    def label_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Word-by-label probabilities of each text (no rows: it has no letter)."""
        if self.scores is None or len(self.cache) > CACHE:
            self.cache, self.scores = {}, np.empty((1024, len(self.labels)), np.float32)
        cache, tokens, new = self.cache, [], []
        for text in texts:
            words = WORD.findall(text.lower()) if text else []
            tokens.append(words)
            for w in set(words).difference(cache):
                cache[w] = len(cache)
                new.append(w)
        if new:
            if len(cache) > len(self.scores):
                self.scores = np.resize(self.scores, (max(len(cache), 2 * len(self.scores)), len(self.labels)))
            self.scores[len(cache) - len(new) : len(cache)] = self.emissions(new)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        if not lengths.sum():
            return [np.empty((0, len(self.labels)))] * len(texts)
        ids = np.fromiter((cache[w] for words in tokens for w in words), np.int64, lengths.sum())
        gamma, _ = posteriors(self.scores[ids].astype(np.float64), lengths[lengths > 0], self.trans, self.start)
        return np.split(gamma, np.cumsum(lengths)[:-1])


def _fit(types: list[str], lexicon: dict[str, int], ids: np.ndarray, lengths: np.ndarray, gold: np.ndarray, labels: list[str], weights: np.ndarray | None, chain: bool, steps: int, rate: float = 0.5, decay: float = 1e-6) -> Crf:
    """Conditional likelihood by full-batch Adagrad. ``gold``: label probabilities of each word.
    Without ``chain``, words are independent and only feature weights are learned."""
    k = len(labels)
    who, what = features(types, lexicon)
    w = np.zeros((BUCKETS + len(lexicon), k)) if weights is None else weights.copy()
    trans, start = np.zeros((k, k)), np.zeros(k)
    heads = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    wanted = None
    if chain:
        inner = np.ones(len(ids), bool)
        inner[heads] = False
        at = np.flatnonzero(inner)
        wanted = gold[at - 1].T @ gold[at]
        trans = np.log((wanted + 1) / (wanted + 1).sum(axis=1, keepdims=True))
    sums = [np.full_like(x, 1e-8) for x in (w, trans, start)]
    n = len(ids)
    for _ in range(steps):
        scores = _sum_by(who, w[what], len(types))
        if chain:
            gamma, counts = posteriors(scores[ids], lengths, trans, start, pairs=True)
        else:
            x = np.exp(scores - scores.max(axis=1, keepdims=True))
            gamma, counts = (x / x.sum(axis=1, keepdims=True))[ids], None
        diff = gold - gamma
        per_type = _sum_by(ids, diff, len(types))
        grads = [_sum_by(what, per_type[who], len(w)) / n - decay * w]
        if chain:
            grads += [(wanted - counts) / n, diff[heads].sum(axis=0) / n]
        for param, grad, total in zip((w, trans, start), grads, sums, strict=False):
            total += grad * grad
            param += rate * grad / np.sqrt(total)
    return Crf(labels, lexicon, w, trans, start)


def train(rows: list[tuple[str, str]], lexicon_size: int = 20_000, steps: tuple[int, int] = (15, 12)) -> Crf | None:
    """Learn from (text, language) rows; None if none has a word."""
    tokens = [(WORD.findall((t or "").lower()), l) for t, l in rows]
    tokens = [x for x in tokens if x[0]]
    if not tokens:
        return None
    labels = sorted({l for _, l in tokens})
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words, _ in tokens for w in words), np.int64)
    lengths = np.array([len(w) for w, _ in tokens])
    types = list(number)
    counts = np.bincount(ids, minlength=len(types))
    order = sorted(range(len(types)), key=lambda i: (-counts[i], types[i]))[:lexicon_size]
    lexicon = {types[i]: j for j, i in enumerate(order) if counts[i] >= 3}
    own = np.repeat([labels.index(l) for _, l in tokens], lengths)
    gold = np.full((len(ids), len(labels)), 0.0)
    gold[np.arange(len(ids)), own] = 1.0
    if len(labels) == 1:
        return Crf(labels, lexicon, np.zeros((BUCKETS + len(lexicon), 1)), np.zeros((1, 1)), np.zeros(1))
    # a document's label holds for most of its words, not for each
    first = _fit(types, lexicon, ids, lengths, 0.9 * gold + 0.1 / len(labels), labels, None, False, steps[0])
    k = len(labels)
    sticky = np.log(np.full((k, k), 0.01 / (k - 1)) + np.eye(k) * (0.99 - 0.01 / (k - 1)))
    relabelled, _ = posteriors(first.emissions(types)[ids] + np.log(0.9 * gold + 0.1 / k), lengths, sticky, np.zeros(k))
    return _fit(types, lexicon, ids, lengths, relabelled, labels, first.weights, True, steps[1])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def chosen(docs: DataFrame, sample_docs: int, sample_chars: int) -> DataFrame | None:
    """Rows (text, lang, place, no) of every labelled language, chosen by a hash of their content:
    ``sample_docs`` of each, or fewer where there are over 64 languages, so that the total stays
    bounded; None if no row is labelled. A language that has only texts over ``sample_chars`` gives
    ``LONG_DOCS`` of them, whole. ``place`` and ``no`` give their order."""
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    short = F.length("text") <= sample_chars
    drawn = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = rows.groupBy("lang").agg(F.count("*").alias("all"), F.count(F.when(short, 1)).alias("short")).orderBy(F.desc("short"), "lang").collect()
    if not counts:
        return None
    each = max(1, min(sample_docs, 64 * sample_docs // len(counts)))
    # some more than wanted are drawn, and the first of them taken
    asked = [(r["lang"], r["short"] > 0, n := each if r["short"] else min(each, LONG_DOCS), (2.0 * n + 20) / (r["short"] or r["all"]), i) for i, r in enumerate(counts)]
    asked = docs.sparkSession.createDataFrame(asked, "lang string, is_short boolean, wanted int, share double, place int")
    picked = rows.select("text", F.col("lang").cast("string").alias("lang"), drawn.alias("drawn"), "doc_id", short.alias("is_short"))
    picked = picked.join(F.broadcast(asked), ["lang", "is_short"]).filter(F.col("drawn") <= F.col("share"))
    picked = picked.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "doc_id"))).filter("no <= wanted")
    return picked.select(F.col("text").cast("string").alias("text"), "lang", "place", "no")


def sample(docs: DataFrame, sample_docs: int, sample_chars: int) -> list[tuple[str, str]]:
    """(text, lang) of the ``chosen`` rows, in their order."""
    rows = chosen(docs, sample_docs, sample_chars)
    return [(x["text"], x["lang"]) for x in sorted(rows.collect() if rows else [], key=lambda x: (x["place"], x["no"]))]


def _learn(batches):
    """The model learned from the rows of a sample, as numbered pieces."""
    rows = sorted((x for batch in batches for x in zip(*(batch[c].to_pylist() for c in ("place", "no", "text", "lang")), strict=True)), key=lambda x: x[:2])
    model = pickle.dumps(train([x[2:] for x in rows]))
    for i, at in enumerate(range(0, len(model), PIECE)):
        yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "piece": pa.array([model[at : at + PIECE]], pa.binary())})


def learned(docs: DataFrame, sample_docs: int, sample_chars: int) -> Crf | None:
    """The model of a sample, learned by one task: arrays over all words of the sample take some
    hundred MB, which the driver is spared. It gathers the model only."""
    rows = chosen(docs, sample_docs, sample_chars)
    if rows is None:
        return None
    pieces = rows.coalesce(1).mapInArrow(released(_learn), "i int, piece binary").collect()
    return pickle.loads(b"".join(bytes(x["piece"]) for x in sorted(pieces, key=lambda x: x["i"]))) if pieces else None


def _rows(crf: Crf | None, texts: list[str | None]):
    """(language, score, words, switches) of each text; arrays stay small whatever the batch."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < TOGETHER):
            size += len(texts[end] or "")
            end += 1
        for gamma in crf.label_texts(texts[at:end]) if crf else [np.empty((0, 1))] * (end - at):
            if not len(gamma):
                yield UNKNOWN, 0.0, 0, 0
                continue
            share, most = gamma.mean(axis=0), gamma.argmax(axis=1)
            best = int(share.argmax())
            yield crf.labels[best], min(1.0, float(share[best])), len(gamma), int((most[1:] != most[:-1]).sum())
        at = end


def _predict(crf: Crf | None):
    types = [("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("n_switches", pa.int64())]

    def of(batches):
        for batch in batches:
            found = list(_rows(crf, batch["text"].to_pylist()))
            new = [pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True) if found else [[]] * 4, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *new], ["doc_id", "held_out", *(n for n, _ in types)])

    return of


def identify(docs: DataFrame, sample_docs: int = 250, sample_chars: int = 6000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_words, n_switches`` of each document."""
    small_batches(docs.sparkSession)
    crf = learned(docs, sample_docs, sample_chars)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(_predict(crf)), "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long")


def _known(crf: Crf | None, min_score: float):
    def of(batches):
        for batch in batches:
            keep = [lang != UNKNOWN and score >= min_score for lang, score, _, _ in _rows(crf, batch["text"].to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return of


def keep_known(docs: DataFrame, min_score: float = 0.3, sample_docs: int = 250, sample_chars: int = 6000) -> DataFrame:
    """``docs`` without those of no language: no letters, or no language with at least
    ``min_score`` of the words."""
    small_batches(docs.sparkSession)
    crf = learned(docs, sample_docs, sample_chars)
    return docs.mapInArrow(released(_known(crf, min_score)), docs.schema)
