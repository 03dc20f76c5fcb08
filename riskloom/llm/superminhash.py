"""Near duplicates by SuperMinHash bands, confirmed on whole shingle sets, and grouped by union-find."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from riskloom.llm import simhash
from riskloom.llm.components import components
from riskloom.session import scratch, stage


@dataclass(frozen=True)
class NearConfig:
    #: Words of a shingle, and the least similarity of a link in percent.
    words: int = 4
    percent: int = 80
    #: Bands of rows of the signature: a pair of similarity 0.8 shares none of them once in 300,000 times.
    bands: int = 24
    rows: int = 4
    #: Rounds in which every text meets one leader of each of its buckets, before the exact search of the rest.
    rounds: int = 1
    #: Pairs of one leader that share a task.
    spread: int = 2048


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose permutations are held at once.
_AT_ONCE = 1 << 15


# --- shingles and signatures ---------------------------------------------------------------------------


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text; a text of fewer words is one shingle, one of none has none."""
    # bytes.lower changes A-Z only; bytes.split cuts at x20 and x09-x0D only.
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    n, joined = min(words, len(tokens)), b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    first, last = [0, *ends[: len(tokens) - n].tolist()], (ends[n - 1 :] - 1).tolist()
    hash_ = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_(joined[a:b], 42) for a, b in zip(first, last, strict=True)], np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash signatures of some sets of shingles, one row each; those of an empty set are infinite.

    In round j each shingle draws the next place of its own random permutation and offers j plus a fraction there; the least offer
    stays. The ranks of one shingle thus differ in all places, which is what lowers the variance. A set is done once all its places hold
    less than j: nothing that later rounds offer is smaller.
    """
    out = np.full((len(sets), size), np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shingle = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    for at in range(0, len(shingle), _AT_ONCE):
        x, who = shingle[at : at + _AT_ONCE], owner[at : at + _AT_ONCE]
        place = np.tile(np.arange(size, dtype=np.int16), (len(x), 1))
        row = np.arange(len(x))
        for j in range(size):
            row = row[out[who[row[0]] : who[row[-1]] + 1].max(1)[who[row] - who[row[0]]] > j] if len(row) else row
            if not len(row):
                break
            draw = _mix(x[row] + np.uint64((j + 1) * int(_ODD) % (1 << 64)))
            k = j + (_mix(draw ^ _ODD) % np.uint64(size - j)).astype(np.int64)
            chosen = place[row, k]
            place[row, k] = place[row, j]
            np.minimum.at(out.reshape(-1), who[row] * size + chosen, j + (draw >> np.uint64(11)) * 2.0**-53)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One number for each band of each signature; bands that share it by chance only add a pair to confirm."""
    parts = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) * _ODD, parts.shape[:2]).copy()
    for c in range(rows):
        key = _mix(key ^ parts[:, :, c]) * _ODD
    return key.view(np.int64)


def sketch(text: Column, config: NearConfig) -> Column:
    """``(n, sid, bands)`` of each text: its number of shingles, a 128-bit digest of the set, and a number for each band.

    Texts without words have no digest and no bands.
    """
    kind = pa.struct([("n", pa.int64()), ("sid", pa.binary()), ("bands", pa.list_(pa.int64()))])

    @arrow_udf("n long, sid binary, bands array<long>")
    def run(batch: pa.Array) -> pa.Array:
        n, sid, bands, held = [], [], [], []

        def flush() -> None:
            if not held:  # the batch ended with the last flush, or is empty
                return
            bands.extend(band_keys(signatures(held, config.bands * config.rows), config.rows))
            held.clear()

        for x in batch:
            found = shingles(x.as_py(), config.words)
            n.append(len(found))
            sid.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            held.append(found)
            if sum(map(len, held[-64:])) >= _AT_ONCE or len(held) == 64:
                flush()
        flush()
        keys = [b if s else b[:0] for b, s in zip(bands, sid, strict=True)]
        ends = np.cumsum([0, *map(len, keys)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if len(keys) else [], pa.int64()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(sid, pa.binary()), lists], fields=list(kind))

    return run(text.cast("binary"))


# --- verification --------------------------------------------------------------------------------------


class _Parts:
    """Union-find over the texts that a task has met."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        while (above := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[above]
            x = above
        return x

    def join(self, x: bytes, y: bytes) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Common members of two sorted arrays of distinct numbers."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts()
        for batch in batches:
            u, v = [], []
            for a, b, x, y in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if len(parts.up) > 1_000_000:
                    parts = _Parts()  # only spares repeated links
                if parts.root(a) == parts.root(b):
                    continue
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = _shared(x, y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    parts.join(a, b)
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, config: NearConfig) -> DataFrame:
    """The pairs ``(u, v)`` that are links; pairs whose texts other links of the same task already join are left out.

    ``v`` may come in any number of pairs: they are dealt over tasks by a salt, and its set goes to each of them.
    """
    busy = pairs.groupBy("v").agg(F.ceil(F.count("*") / config.spread).alias("s"))
    held = sets.withColumnRenamed("sid", "v").join(busy, "v").select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("salt"), F.col("set").alias("y"))
    dealt = pairs.join(busy, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("s")).alias("salt"))
    with_u = dealt.join(sets.select(F.col("sid").alias("u"), F.col("set").alias("x")), "u")
    met = with_u.join(held.hint("merge"), ["v", "salt"]).select("u", "v", "x", "y")
    return stage(met.mapInArrow(_confirm(config.percent), "u binary, v binary"), "near-links")


# --- candidates ----------------------------------------------------------------------------------------


def _named(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """``rows(sid, ...)`` with ``c``, the least text that a few steps along the links reach.

    Two steps join all texts of one leader, further ones leaders that share a text. Texts of one ``c`` are linked; parts that more steps
    would join only bring pairs that need not have been looked at.
    """
    if links is None:
        return rows.withColumn("c", F.col("sid"))
    both = stage(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "near-both")
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("c"))
    for _ in range(2):
        least = both.join(least.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("c"))
    return _by_root(rows, least.select(F.col("u").alias("node"), F.col("c").alias("root")))


def _by_root(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows(sid, ...)`` with ``c``, the text that names their part."""
    if roots is None:
        return rows.withColumn("c", F.col("sid"))
    return rows.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("c", F.coalesce("root", "sid")).drop("root")


def _to_leaders(buckets: DataFrame, draw: int) -> DataFrame:
    """Every text of ``buckets(k, sid, c, reach)`` with one leader of each of its buckets, if they are not joined yet.

    The leader is the text that shares its buckets with the most others, the likeliest to stand in the middle of its relatives; in later
    rounds chance has a say. The order is the same in all buckets, so that a pair which shares many of them comes once.
    """
    chance = F.lit(1.0) if draw == 0 else F.pmod(F.xxhash64("sid", F.lit(draw)), F.lit(1000)) / 1000.0
    order = F.struct((F.col("reach") * chance).alias("w"), F.xxhash64("sid").alias("h"), "sid", "c")
    lead = buckets.groupBy("k").agg(F.max(order).alias("l")).select("k", F.col("l.sid").alias("v"), F.col("l.c").alias("d"))
    return buckets.join(lead, "k").where("c <> d").select(F.col("sid").alias("u"), "v").distinct()


def _mixed(buckets: DataFrame) -> DataFrame:
    """Rows of the buckets whose texts are not all joined."""
    open_ = buckets.groupBy("k").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("k")
    return buckets.join(open_, "k")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sid = batch.column(0)
        for i, data in enumerate(batch.column(1)):
            h = np.frombuffer(data.as_py(), np.int64)
            for at in range(0, len(h), 1 << 16):
                some = pa.array(h[at : at + (1 << 16)])
                yield pa.RecordBatch.from_arrays([sid.take(pa.array(np.full(len(some), i))), pa.array(np.full(len(some), len(h))), some], ["sid", "n", "h"])


def _rest(texts: DataFrame, sets: DataFrame, config: NearConfig) -> DataFrame:
    """``texts(sid, c)`` -> pairs ``(u, v)`` of different parts that hold all links between these texts.

    Shingles are ordered by how many of these texts have them, the rarest first. Two texts that are similar enough share one of the
    first of each, as many as similarity leaves room for; where the first that they share stands bounds what they can share at all.
    Relatives of one template that are no links differ in their rare shingles, so they do not meet, however many they are.
    """
    least = config.percent
    rows = stage(sets.join(texts.select("sid").distinct(), "sid").select("sid", "set").mapInArrow(_members, "sid binary, n long, h long"), "near-members")
    often = rows.groupBy("h").agg(F.count("*").alias("often")).where("often > 1")
    own = W.partitionBy("sid")
    ranked = rows.join(often, "h").withColumns({"met": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("often", "h"))})
    # Shingles that no other text has come before these, and meet nobody.
    pos = F.col("n") - F.col("met") + F.col("rank") - 1
    first = ranked.select("h", "sid", "n", pos.alias("pos")).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * least / 100))
    first = stage(first.join(texts.select("sid", "c").distinct(), "sid"), "near-first")
    inside = first.groupBy("h", "c").agg(F.count("*").alias("m")).groupBy("h").agg(F.max(F.struct("m", "c")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    # Texts outside the largest part of a shingle meet all others of it; within the largest there is nothing left to join.
    open_ = first.join(inside.select("h", F.col("most.c").alias("largest")), "h")
    x = open_.where("c <> largest").select("h", F.col("sid").alias("u"), F.col("n").alias("un"), F.col("pos").alias("up"), F.col("c").alias("uc"))
    y = open_.select("h", F.col("sid").alias("v"), F.col("n").alias("vn"), F.col("pos").alias("vp"), F.col("c").alias("vc"))
    size = F.least("un", "vn") * 100 >= F.greatest("un", "vn") * least
    share = F.least(F.col("un") - F.col("up"), F.col("vn") - F.col("vp")) * (100 + least) >= (F.col("un") + F.col("vn")) * least
    return x.join(y, "h").where((F.col("uc") != F.col("vc")) & size & share).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def print_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """``prints(sid, fp)`` -> pairs ``(u, v)`` of texts whose SimHash fingerprints meet in the Gray index within ``radius``.

    Texts of one fingerprint meet the least of them, which stands for the fingerprint in the links of the index; so pairs grow with the
    texts. A link's ends may be further apart than the radius, if others lie between them.
    """
    heads = prints.groupBy("fp").agg(F.min("sid").alias("v"))
    same = prints.join(heads, "fp").where("sid <> v").select(F.col("sid").alias("u"), "v")
    far = stage(simhash.link_prints(heads.select("fp"), radius).distinct(), "near-prints-linked")
    head = lambda name: heads.select(F.col("fp").alias(name), F.col("v").alias(f"{name}_sid"))
    met = far.join(head("u"), "u").join(head("v"), "v").select(F.greatest("u_sid", "v_sid").alias("u"), F.least("u_sid", "v_sid").alias("v"))
    return same.union(met).distinct()


def link_sets(buckets: DataFrame, sets: DataFrame, config: NearConfig, near: DataFrame | None = None) -> DataFrame | None:
    """``(node, root)`` of ``buckets(k, sid, reach)`` and ``sets(sid, set)``: the components of all links between texts that share a bucket.

    Those of the pairs ``near(u, v)`` that are links come first. Then texts meet leaders, so that a large group of copies costs pairs in
    proportion to its texts. The texts of buckets that are not one part by then are searched exactly by their rarest shingles.
    """
    links = None if near is None or near.isEmpty() else _confirmed(near, sets, config)
    for r in range(config.rounds):
        pairs = stage(_to_leaders(_mixed(stage(_named(buckets, links), "near-named")), r), "near-pairs")
        if not pairs.isEmpty():
            found = _confirmed(pairs, sets, config)
            links = found if links is None else links.union(found)
    # The exact search needs the whole parts: texts of one part under two names would meet each other, and their pairs grow with their square.
    roots = None if links is None else stage(components(links), "near-roots")
    named = _mixed(stage(_by_root(buckets, roots), "near-named"))
    pairs = stage(_rest(named.select("sid", "c").distinct(), sets, config), "near-pairs")
    if pairs.isEmpty():
        return roots
    found = _confirmed(pairs, sets, config)
    if roots is not None:
        found = found.union(roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    return stage(components(found), "near-roots")


def classes(docs: DataFrame, config: NearConfig, id_: str, text: str, radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(id, digest, n, sid)`` of each row, and ``(sid, class, id, digest)`` of each set: its part, and the row that stands for it.

    The row of the smallest id stands for a set (nulls last), of several with one id that of the smallest digest of the text. With a
    ``radius``, texts whose SimHash fingerprints (of the same shingles) lie within it are compared first, and bands find the rest. Only
    texts that have a pair by fingerprint or share a band are read again. Both tables stay; all others that were staged are deleted.
    """
    spark = docs.sparkSession
    digest = F.xxhash64(F.col(text))
    with scratch(spark) as keep:
        fp = F.lit(None).cast("long") if radius is None else simhash.fingerprint(F.col(text), config.words)
        prints = docs.select(F.col(id_).alias("id"), digest.alias("digest"), sketch(F.col(text), config).alias("s"), fp.alias("fp"))
        rows = keep(prints.select("id", "digest", "s.n", "s.sid", "s.bands", "fp"), "near-prints")
        stands = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
        worded = rows.where("sid is not null")
        first = stage(worded.groupBy("sid").agg(stands), "near-first")
        dealt = worded.groupBy("sid").agg(F.first("bands").alias("bands")).select("sid", F.explode("bands").alias("k"))
        shared = dealt.groupBy("k").agg(F.count("*").alias("size")).where("size > 1")
        met = stage(dealt.join(shared, "k").select("k", "sid", "size"), "near-met")
        buckets = stage(met.join(met.groupBy("sid").agg(F.sum("size").alias("reach")), "sid").select("k", "sid", "reach"), "near-buckets")
        asked, near = buckets.select("sid"), None
        if radius is not None:
            near = stage(print_pairs(worded.groupBy("sid").agg(F.min("fp").alias("fp")), radius), "near-by-print")
            asked = asked.union(near.select("u")).union(near.select("v"))
        wanted = first.join(asked.distinct(), "sid").select("sid", "first.id", "first.digest")
        keyed = docs.select(F.col(id_).alias("_id"), digest.alias("_digest"), F.col(text).cast("binary").alias("text"))
        on = keyed["_id"].eqNullSafe(wanted["id"]) & (keyed["_digest"] == wanted["digest"])
        texts = keyed.join(wanted, on).groupBy("sid").agg(F.first("text").alias("text"))
        sets = stage(texts.select("sid", _as_set(F.col("text"), config.words).alias("set")), "near-sets")
        roots = link_sets(buckets, sets, config, near)
        part = first.withColumn("class", F.col("sid"))
        if roots is not None:
            part = first.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("class", F.coalesce("root", "sid"))
        return rows.drop("bands", "fp"), keep(part.select("sid", "class", "first.id", "first.digest"), "near-classes")


def _as_set(text: Column, words: int) -> Column:
    @arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([shingles(x.as_py(), words).tobytes() for x in batch], pa.binary())

    return run(text)


# --- operators -----------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", config: NearConfig | None = None) -> DataFrame:
    """``(<id>, n_shingles, component_id, kept)`` for each row of ``docs``: its group of linked texts, named by the smallest id.

    Texts are linked if the Jaccard similarity of their whole sets of word shingles reaches ``percent``. A null text counts as an empty one;
    a text without words is linked with nothing, not even with its equal, and is its own component. Rows of a null id are linked like
    others, but name a component only if it has no other id (then null); a row is kept if its id is that of its component. Repeated
    rows are returned, and kept, as often as they come. Other columns are ignored; an empty table gives an empty result.
    """
    config = config or NearConfig()
    rows, parts = classes(docs, config, id_, text)
    names = parts.groupBy("class").agg(F.min("id").alias("component_id"))
    named = parts.join(names, "class").select("sid", "component_id")
    out = rows.where("sid is not null").join(named, "sid").select("id", "n", "component_id")
    alone = rows.where("sid is null").select("id", "n", F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
items AS (
  SELECT rid, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.rid AS u, b.rid AS v FROM items a JOIN items b ON a.g = b.g AND a.rid <> b.rid
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT rid AS u, rid AS v FROM sets UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
named AS (
  SELECT r.u AS rid, min(s.doc_id) AS component_id FROM reach r JOIN sets s ON s.rid = r.v GROUP BY r.u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM sets JOIN named USING (rid)
"""
