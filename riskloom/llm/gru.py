"""Language-model scores: a gated recurrent network with a class-factored output, over counts of the whole corpus."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bounded import top_counts
from riskloom.session import stage

#: The end of a text as a word: no word is empty.
END = b""
BUCKETS = 64
#: Tokens whose class scores are taken at once, and steps of a window, where texts are scored.
BLOCK, WINDOW = 1024, 32
#: Texts that are scored side by side.
STREAMS = 1024
#: Weights that are averaged as one piece.
PIECE = 1 << 16
LOG10 = np.log(10.0)


@dataclass(frozen=True)
class LmConfig:
    #: Words that the network tells apart; the others are classes of words with the same last two bytes, and known by their counts.
    shortlist: int = 4096
    #: Words whose counts travel with the code; the counts of the others are joined.
    table: int = 131_072
    hidden: int = 32
    classes: int = 64
    #: Share of the training texts that the network is fitted on (whole texts, by a hash of the id); counts are of all of them.
    fit_share: float = 1.0
    #: The fit runs on this many parts of a round at least, more where a part would exceed ``replica_tokens``; their weights are averaged after each round.
    replicas: int = 12
    replica_tokens: int = 800_000
    rounds: int = 3
    streams: int = 64
    #: Steps of the truncated backpropagation.
    steps: int = 24
    rate: float = 0.08
    seed: int = 3
    smooth: float = 0.1


def held_out(id_: Column) -> Column:
    """One text in ten, by its id, is never learnt from; a null id is learnt from."""
    return F.coalesce(F.crc32(id_.cast("string")) % 10 == 0, F.lit(False))


def words_of(text: bytes | None) -> list[bytes]:
    # bytes.lower changes A-Z only; bytes.split cuts at x20 and x09-x0D only.
    return (text or b"").lower().split()


def bucket_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[-2:], 42) % BUCKETS


# --- counts --------------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        words = list(seen)
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([seen[w] for w in some], pa.int64())], ["word", "c"])
        seen.clear()

    for batch in batches:
        for text in batch.column(0):
            seen.update(words_of(text.as_py()))
            seen[END] += 1
            if len(seen) > 600_000:
                yield from flush()
    yield from flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, c)`` of all words of ``texts(text)``, and of their ends; combined in each task before the shuffle."""
    return texts.select(F.col("text").cast("binary")).mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """Bounded facts of the counts: the most frequent words with their counts, and totals."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    size: int
    #: Tokens and words of each bucket, of words outside the network's shortlist.
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray


def vocabulary(counts: DataFrame, config: LmConfig) -> Vocabulary:
    top = top_counts(counts, config.table).collect()
    found = {bytes(r["word"]): r["c"] for r in top}
    if counts_end := counts.where(F.length("word") == 0).first():
        found[END] = counts_end["c"]
    top = sorted(found.items(), key=lambda x: (x[0] != END, -x[1], x[0]))
    bucket = F.pmod(F.xxhash64(F.when(F.length("word") > 2, F.substring("word", -2, 2)).otherwise(F.col("word"))), F.lit(BUCKETS))
    tokens, words = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy(bucket.alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        tokens[r["b"]], words[r["b"]] = r["c"], r["n"]
    total, size = int(tokens.sum()), int(words.sum())
    for w, c in top[: config.shortlist]:
        tokens[bucket_of(w)] -= c
        words[bucket_of(w)] -= 1
    return Vocabulary([w for w, _ in top], np.array([c for _, c in top], float), total, size, tokens, words)


# --- network -------------------------------------------------------------------------------------------


class Network:
    """Weights: input rows of the three gates for each word or bucket, recurrent gates, class scores, word scores in a class.

    Class and word biases begin at the logarithms of the counts, so an untrained network is the unigram model.
    """

    def __init__(self, vocabulary: Vocabulary, config: LmConfig):
        self.config = config
        #: Tokens that the weights have been fitted on.
        self.fitted = 0
        self.end = 0  # the end mark comes first in the shortlist
        k = self.k = min(config.shortlist, len(vocabulary.words))
        h, rng = config.hidden, np.random.default_rng(config.seed)
        count = vocabulary.counts[:k] + config.smooth
        # Classes of about the same mass of square-root frequencies.
        mass = np.cumsum(np.sqrt(count))
        self.word_class = np.minimum((config.classes * (mass - np.sqrt(count)) / max(mass[-1] if k else 1.0, 1e-9)).astype(np.int64), config.classes - 1)
        self.starts = np.searchsorted(self.word_class, np.arange(config.classes + 1))
        rare = vocabulary.bucket_tokens + config.smooth * (vocabulary.bucket_words + 1)
        weight = np.concatenate((np.bincount(self.word_class, count, config.classes), rare))
        self.empty = weight <= 0
        self.p = {
            "x": rng.normal(0, 0.1, (k + BUCKETS, 3 * h)), "u": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)), "wc": np.zeros((h, config.classes + BUCKETS)),
            "bc": np.where(self.empty, -1e4, np.log(np.maximum(weight, 1e-9))), "v": np.zeros((k, h)), "bv": np.log(count),
        }
        self.p = {n: a.astype(np.float32) for n, a in self.p.items()}

    def advance(self, ids: np.ndarray, reset: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each of the steps, (steps, streams, hidden); ``reset`` marks the streams that begin a text."""
        n, saved = self.config.hidden, []
        out = np.empty((len(ids), ids.shape[1], n), np.float32)
        x, u = self.p["x"], self.p["u"]
        for t in range(len(ids)):
            if reset[t].any():
                h = h * ~reset[t][:, None]
            gx, gh = x[ids[t]], h @ u
            gates = gx[:, : 2 * n] + gh[:, : 2 * n]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            r, z = gates[:, :n], gates[:, n:]
            new = np.tanh(gx[:, 2 * n :] + r * gh[:, 2 * n :])
            old, h = h, new + z * (h - new)
            out[t] = h
            if keep:
                saved.append((old, r, z, new, gh[:, 2 * n :]))
        return out, saved

    def log_probability(self, states: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target (a shortlist word, or shortlist + bucket); with ``grad``, its gradients too."""
        k, classes, p = self.k, self.config.classes, self.p
        cls = np.where(target < k, self.word_class[np.minimum(target, k - 1)], classes + target - k)
        out, back = np.empty(len(target)), None
        # Without gradients a block at a time, small enough for the cache.
        size = BLOCK if grad is None else max(len(target), 1)
        for a in range(0, len(target), size):
            some = cls[a : a + size]
            score = states[a : a + size] @ p["wc"]
            score += p["bc"]
            _lower(score)
            row = np.arange(len(some))
            picked = score[row, some]
            np.exp(score, out=score)
            z = score.sum(1)
            out[a : a + size] = picked - np.log(z)
        if grad is not None:
            score /= z[:, None]
            score[row, cls] -= 1
            grad["wc"], grad["bc"] = states.T @ score, score.sum(0)
            back = score @ p["wc"].T
            grad["v"] = {}
        order = np.argsort(cls, kind="stable")
        cut = np.searchsorted(cls[order], np.arange(classes + 1))
        for c in np.flatnonzero(np.diff(cut)):
            at, lo, hi = order[cut[c] : cut[c + 1]], self.starts[c], self.starts[c + 1]
            if hi - lo == 1:
                continue
            hidden = states[at]
            s = hidden @ p["v"][lo:hi].T
            s += p["bv"][lo:hi]
            _lower(s)
            i, j = np.arange(len(at)), target[at] - lo
            one = s[i, j]
            np.exp(s, out=s)
            z = s.sum(1)
            out[at] += one - np.log(z)
            if grad is not None:
                s /= z[:, None]
                s[i, j] -= 1
                grad["v"][lo, hi] = (s.T @ hidden, s.sum(0))
                back[at] += s @ p["v"][lo:hi]
        return out, back

    def fit(self, streams: np.ndarray, reset: np.ndarray, lengths: np.ndarray) -> None:
        """One pass of truncated backpropagation over padded streams of (inputs; targets one step on), by Adagrad."""
        c, n = self.config, self.config.hidden
        seen = {name: np.full_like(a, 0.02) for name, a in self.p.items()}

        def move(name: str, at, g: np.ndarray) -> None:
            seen[name][at] += g * g
            self.p[name][at] -= c.rate * g / np.sqrt(seen[name][at])

        h = np.zeros((streams.shape[1], n), np.float32)
        for t0 in range(0, len(streams) - 1, c.steps):
            active = int((lengths > t0 + 1).sum())
            if not active:
                break
            ids = streams[t0 : t0 + c.steps, :active]
            target = streams[t0 + 1 : t0 + 1 + c.steps, :active]
            ids = ids[: len(target)]
            # The step onto the first symbol of the next text is no prediction.
            real = (np.arange(t0 + 1, t0 + 1 + len(target))[:, None] < lengths[None, :active]) & ~reset[t0 + 1 : t0 + 1 + len(target), :active]
            states, saved = self.advance(ids, reset[t0 : t0 + len(ids), :active], h[:active], keep=True)
            h = states[-1]
            flat, goal, mask = states.reshape(-1, n), target.ravel(), real.ravel()
            if not mask.any():
                continue
            grad: dict = {}
            _, back = self.log_probability(flat[mask], goal[mask], grad)
            scale = np.float32(1 / active)
            dout = np.zeros_like(flat)
            dout[mask] = back * scale
            dout = dout.reshape(states.shape)
            du, dgx = np.zeros_like(self.p["u"]), np.empty((len(ids), active, 3 * n), np.float32)
            dh = np.zeros((active, n), np.float32)
            for t in range(len(ids) - 1, -1, -1):
                old, r, z, new, ghn = saved[t]
                dh = dh + dout[t]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (old - new) * z * (1 - z)
                dr = dn * ghn * r * (1 - r)
                dgx[t, :, :n], dgx[t, :, n : 2 * n], dgx[t, :, 2 * n :] = dr, dz, dn
                dgh = np.concatenate((dr, dz, dn * r), 1)
                du += old.T @ dgh
                dh = (dh * z + dgh @ self.p["u"].T) * ~reset[t0 + t, :active][:, None]
            word, g = ids.ravel(), dgx.reshape(-1, 3 * n)
            order = np.argsort(word, kind="stable")
            first = np.flatnonzero(np.diff(word[order], prepend=-1))
            norm = float(np.sqrt((du**2).sum()))
            clip = np.float32(min(1.0, 5.0 / max(norm, 1e-9)))
            move("x", word[order][first], np.add.reduceat(g[order], first, axis=0))
            move("u", slice(None), du * clip)
            move("wc", slice(None), grad["wc"] * scale)
            move("bc", slice(None), np.where(self.empty, 0, grad["bc"]).astype(np.float32) * scale)
            for (lo, hi), (gv, gb) in grad["v"].items():
                move("v", slice(lo, hi), gv * scale)
                move("bv", slice(lo, hi), gb * scale)

    def score(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each text, given as the numbers of its words; state runs on through the windows of a text."""
        begin = self.end
        out = np.zeros(len(texts))
        total, longest = sum(len(t) + 1 for t in texts), max((len(t) + 1 for t in texts), default=1)
        # So many streams that padding stays below the texts themselves.
        width = max(1, min(STREAMS, total // longest + 1, len(texts)))
        ids, reset, lengths, owner = pack(texts, width, begin)
        h = np.zeros((width, self.config.hidden), np.float32)
        for t0 in range(0, len(ids) - 1, WINDOW):
            active = int((lengths > t0 + 1).sum())
            if not active:
                break
            target = ids[t0 + 1 : t0 + 1 + WINDOW, :active]
            n = len(target)
            states, _ = self.advance(ids[t0 : t0 + n, :active], reset[t0 : t0 + n, :active], h[:active], keep=False)
            h = states[-1]
            real = ((np.arange(t0 + 1, t0 + 1 + n)[:, None] < lengths[None, :active]) & ~reset[t0 + 1 : t0 + 1 + n, :active]).ravel()
            lp, _ = self.log_probability(states.reshape(n * active, -1)[real], target.ravel()[real])
            out += np.bincount(owner[t0 + 1 : t0 + 1 + n, :active].ravel()[real], lp, len(texts))
        return out

def _lower(score: np.ndarray) -> None:
    """Take each row's largest score off where exponentials could overflow; elsewhere they are exact enough as they are."""
    if score.size and score.max() > 60:
        score -= score.max(1, keepdims=True)


def pack(texts: Sequence[np.ndarray], width: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in streams of about the same length, longest stream first: numbers, where a text begins, lengths, and whose each is.

    A text is the end mark that it begins with, its words, and its end.
    """
    heap = [(0, s) for s in range(width)]
    held: list[list[int]] = [[] for _ in range(width)]
    for i in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        size, s = heapq.heappop(heap)
        held[s].append(i)
        heapq.heappush(heap, (size + len(texts[i]) + 2, s))
    held.sort(key=lambda x: -sum(len(texts[i]) + 2 for i in x))
    lengths = np.array([sum(len(texts[i]) + 2 for i in x) for x in held], np.int64)
    shape = (int(lengths.max(initial=0)), width)
    ids, reset, owner = np.zeros(shape, np.int32), np.zeros(shape, bool), np.zeros(shape, np.int32)
    for s, some in enumerate(held):
        at = 0
        for i in some:
            n = len(texts[i])
            ids[at, s] = ids[at + n + 1, s] = end
            ids[at + 1 : at + n + 1, s] = texts[i]
            reset[at, s] = True
            owner[at : at + n + 2, s] = i
            at += n + 2
    return ids, reset, lengths, owner


# --- words to numbers ----------------------------------------------------------------------------------


class _Numbers(dict):
    """Place of a word in the table; below zero, the bucket of a word that is not in it."""

    def __missing__(self, word: bytes) -> int:
        return -1 - bucket_of(word)


def _numbers(vocabulary: Vocabulary) -> tuple[_Numbers, np.ndarray]:
    """The table, and the network's number of each of its words."""
    return _Numbers(zip(vocabulary.words, range(len(vocabulary.words)), strict=True)), np.array([bucket_of(w) for w in vocabulary.words], np.int64)


def _model_ids(found: np.ndarray, bucket: np.ndarray, k: int) -> np.ndarray:
    return np.where(found < 0, k - 1 - found, np.where(found < k, found, k + bucket[np.maximum(found, 0)])).astype(np.int32)


# --- fit -----------------------------------------------------------------------------------------------


def _replica(network: Network, vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bucket = _numbers(vocabulary)
        texts, held, fitted = [], 0, 0

        def learn() -> None:
            ids, reset, lengths, _ = pack(texts, min(network.config.streams, len(texts)), network.end)
            network.fit(ids, reset, lengths)

        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                texts.append(_model_ids(np.fromiter(map(table.__getitem__, words), np.int64, len(words)), bucket, network.k))
                held += len(words) + 1
                if held > 400_000:
                    learn()
                    texts, fitted, held = [], fitted + held, 0
        if texts:
            learn()
            fitted += held
        if fitted:
            flat = np.concatenate([network.p[n].ravel() for n in sorted(network.p)])
            pieces = range(0, len(flat), PIECE)
            yield pa.RecordBatch.from_arrays([pa.array([at // PIECE for at in pieces], pa.int64()), pa.array([fitted] * len(pieces), pa.int64()), pa.array([flat[at : at + PIECE].tobytes() for at in pieces], pa.binary())], ["piece", "tokens", "weights"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece of the weights, averaged over the replicas by their tokens."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for piece, tokens, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            seen, total = sums.get(piece, (0, 0.0))
            sums[piece] = seen + tokens, total + np.frombuffer(weights.as_py(), np.float32).astype(float) * tokens
    if sums:
        blobs = [(total / seen).astype(np.float32).tobytes() for seen, total in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([seen for seen, _ in sums.values()], pa.int64()), pa.array(blobs, pa.binary())], ["piece", "tokens", "weights"])


def fit(texts: DataFrame, vocabulary: Vocabulary, config: LmConfig) -> Network:
    """Network of ``texts(id, text)``, averaged over the replicas after each round, by the tokens that each has seen.

    The replicas grow in number with the tokens and are averaged on the executors, piece by piece; the driver holds one network.
    So the same text has another score in a larger corpus, by the other counts and by the other number of replicas. In a replica the sums
    of Adagrad and the states begin anew every 400,000 tokens.
    """
    network = Network(vocabulary, config)
    replicas = max(config.replicas, int(-(-vocabulary.total * config.fit_share // (config.rounds * config.replica_tokens))))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.col("text"), F.lit(config.seed)), F.lit(1_000_000))
    share = int(config.fit_share * 1_000_000)
    some = stage(texts.select(F.col("text").cast("binary").alias("text"), draw.alias("draw")).where(F.col("draw") < share), "lm-fit")
    for r in range(config.rounds):
        part = some.where(F.pmod(F.col("draw"), F.lit(config.rounds)) == r).select("text").repartition(replicas)
        kind = "piece long, tokens long, weights binary"
        got = part.mapInArrow(_replica(network, vocabulary), kind).repartition("piece").mapInArrow(_average, kind).collect()
        if not got:
            continue
        network.fitted += got[0]["tokens"]
        flat, at = np.concatenate([np.frombuffer(bytes(g["weights"]), np.float32) for g in sorted(got, key=lambda g: g["piece"])]), 0
        for name in sorted(network.p):
            size, shape = network.p[name].size, network.p[name].shape
            network.p[name] = flat[at : at + size].reshape(shape).copy()
            at += size
    return network


# --- scores --------------------------------------------------------------------------------------------


def _score(network: Network, vocabulary: Vocabulary):
    c = network.config

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bucket = _numbers(vocabulary)
        k = network.k
        base_of = np.log10(vocabulary.counts + c.smooth)
        base_all = np.log10(vocabulary.total + c.smooth * (vocabulary.size + 1))
        # Of a word in its bucket: its count over the bucket's, with room for one word more.
        inside = np.log10(np.maximum(vocabulary.bucket_tokens, 0) + c.smooth * (np.maximum(vocabulary.bucket_words, 0) + 1))
        for batch in batches:
            texts, facts = [], []
            rare_words, rare_counts, ends = [], [], [0]
            for text in batch.column(3):
                words = words_of(text.as_py())
                found = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
                known = found[found >= 0]
                other = found[found < 0]
                beyond = known[known >= k]
                end = base_of[0] if len(base_of) else np.log10(c.smooth)
                facts.append((
                    len(words) + 1, len(known) + bool(vocabulary.total), base_of[known].sum() + end - (len(words) + 1) * base_all,
                    base_of[beyond].sum() - inside[bucket[beyond]].sum() - inside[-1 - other].sum(),
                ))
                texts.append(_model_ids(found, bucket, k))
                rare = Counter(words[i] for i in np.flatnonzero(found < 0).tolist())
                rare_words += rare.keys()
                rare_counts += rare.values()
                ends.append(len(rare_words))
            total = np.zeros(len(texts))
            if vocabulary.total:
                total = network.score(texts) / LOG10
            columns = list(zip(*facts, strict=True)) if facts else [[]] * 4
            pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], ["word", "n"])
            pairs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(total + np.array(columns[3], float)), pairs],
                ["rid", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
            )

    return run


def scores(docs: DataFrame, id_: str = "doc_id", text: str = "text", config: LmConfig | None = None) -> DataFrame:
    """``(<id>, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    The model's probability of a word is that of its class by the network, times that in its class: by the network for words
    of the shortlist, else by the word's count in the whole training corpus among the words of its bucket, smoothed as the base
    is. Null and empty texts are one end. Repeated rows are learnt from and scored each. Without training texts there are no
    words: every token of the base is unseen, and the score is that of the base.
    """
    config = config or LmConfig()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_).cast("long").alias("id"), held_out(F.col(id_)).alias("held_out"), F.col(text).cast("binary").alias("text"))
    train = rows.where(~F.col("held_out"))
    counts = stage(word_counts(train), "lm-counts")
    words = vocabulary(counts, config)
    if not words.total:
        # log10(0.1 / (0 + 0.1 * (0 + 1))) is 0 for every token.
        n = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long") + 1
        zero, none = F.lit(0.0), F.lit(0).cast("long")
        return rows.select(F.col("id").alias(id_), "held_out", n.alias("n_tokens"), none.alias("n_known"), none.alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))
    network = fit(train, words, config)
    kind = "rid long, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:binary,n:bigint>>"
    part = stage(rows.mapInArrow(_score(network, words), kind), "lm-scores")
    # Words outside the table: their counts are joined, and their share of both scores is one sum.
    rare = part.where(F.size("rare") > 0).select("rid", F.explode("rare").alias("w")).select("rid", "w.word", "w.n").join(counts, "word", "left")
    sums = rare.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + config.smooth)).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"))
    more = F.coalesce("s", F.lit(0.0))
    return part.drop("rare").join(sums, "rid", "left").select(
        F.col("id").alias(id_), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
