"""Merkle manifest of a dataset: each aligned block keeps a level of its tree as one string of hex digests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import global_ordinal
from riskloom.session import stage

#: Characters of a digest in a level string.
HEX = 64


@dataclass(frozen=True)
class MerkleConfig:
    #: Nodes of a run that become one parent, and levels of a block; a block has ``fan ** levels`` nodes.
    fan: int = 2
    levels: int = 10

    @property
    def width(self) -> int:
        return self.fan**self.levels


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of some fields: each ``-`` if null, else its length in UTF-8 bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


# --- levels of a block ---------------------------------------------------------------------------------


def _parents(level: Column, fan: int) -> Column:
    """The level above: fixed-width substrings of a level string, hashed run by run; the last run may be shorter.

    Level strings are kept as bytes, in which a substring is found without counting the characters before it.
    """
    run = fan * HEX
    digests = F.transform(F.sequence(F.lit(1), F.length(level), F.lit(run)), lambda at: F.sha2(F.substring(level, at, F.lit(run)), 256))
    return F.array_join(digests, "").cast("binary")


def _levels(lowest: Column, whole_tree: Column, config: MerkleConfig) -> Column:
    """All level strings of a block, lowest first. The only block of its tree ends at its root, others climb all levels."""

    def climb(have: Column, _: Column) -> Column:
        top = F.element_at(have, -1)
        return F.when(whole_tree & (F.length(top) <= HEX), have).otherwise(F.concat(have, F.array(_parents(top, config.fan))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(config.levels)), F.array(lowest), climb)


def _segments(levels: Column, place: Column, fan: int) -> Column:
    """What stands left and right of a node's ancestors in their runs, level by level."""

    def flanks(level: Column, up: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(fan)), up)).cast("int")
        inside = at % fan
        left = F.substring(level, (at - inside) * HEX + 1, inside * HEX).cast("string")
        right = F.substring(level, (at + 1) * HEX + 1, (fan - 1 - inside) * HEX).cast("string")
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), flanks)


def climb(nodes: DataFrame, config: MerkleConfig) -> tuple[DataFrame, DataFrame]:
    """``nodes(key, pos, hash, load)`` -> ``(key, pos, hash, load, path, top)`` and ``(key, top)``: a tree for each key over its nodes by ``pos``.

    ``pos`` runs from 0 without gaps. ``path`` holds the siblings left and right of the node and of its ancestors, ``top`` the root.
    Blocks of ``fan ** levels`` nodes are rows; their roots are the nodes of the next round, so each round has that many fewer.
    """
    packed = nodes.groupBy("key", F.floor(F.col("pos") / config.width).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "hash", "load"))).alias("nodes")
    )
    packed = stage(packed, "merkle-blocks")
    sizes = packed.groupBy("key").agg(F.count("*").alias("blocks"))
    lowest = F.array_join(F.transform("nodes", lambda x: x["hash"]), "").cast("binary")
    blocks = packed.join(sizes, "key").withColumn("levels", _levels(lowest, F.col("blocks") == 1, config))
    above = blocks.select("key", F.col("block").alias("pos"), F.element_at("levels", -1).cast("string").alias("hash"), F.lit(None).cast("boolean").alias("load"))
    if (sizes.agg(F.max("blocks")).first()[0] or 1) > 1:
        # Keys of one block are lone nodes from here on and keep their root.
        upper = climb(above, config)[0].select("key", F.col("pos").alias("block"), F.col("path").alias("upper"), "top")
    else:
        none = F.array().cast("array<struct<left:string,right:string>>")
        upper = above.select("key", F.col("pos").alias("block"), none.alias("upper"), F.col("hash").alias("top"))
    full = stage(blocks.drop("blocks").join(upper, ["key", "block"]), "merkle-levels")
    rows = F.transform("nodes", lambda x, i: F.struct(x["pos"].alias("pos"), x["hash"].alias("hash"), x["load"].alias("load"), F.concat(_segments(F.col("levels"), i, config.fan), F.col("upper")).alias("path")))
    return full.select("key", "top", F.explode(rows).alias("row")).select("key", "row.*", "top"), full.where("block = 0").select("key", "top")


# --- operators -----------------------------------------------------------------------------------------


def manifest(rows: DataFrame, fields: Sequence[str], order: str, group: str, load: Column | None = None, config: MerkleConfig | None = None) -> DataFrame:
    """``(<order>, load, leaf, path, subroot, root)`` for each row: its digest, its siblings on the way up, and the roots.

    A leaf is the digest of ``fields``. The rows of a ``group`` value form a tree by ascending ``order``, and the trees' roots, by
    group (null first, then bytewise), form one more. Rows of a null ``order`` come last in their group; rows that share it are
    ordered by their digests, and equal rows are leaves of their own. ``load`` travels with each row (null if not given). Texts of
    any length and empty ones are hashed whole. An empty table has no rows and no root. Other columns are ignored.

    Only digests, ids and loads are sorted; equal rows are dealt over the range partitions by a salt.
    """
    config = config or MerkleConfig()
    load = F.lit(None).cast("string") if load is None else load
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = stage(rows.select(F.col(order).alias("id"), key.alias("key"), leaf_digest([F.col(f) for f in fields]).alias("hash"), load.alias("load")), "merkle-leaves")
    placed = global_ordinal(leaves.withColumn("salt", F.monotonically_increasing_id()), ["key", "id", "hash", "salt"])
    first = placed.groupBy("key").agg(F.min("ordinal").alias("first"))
    nodes = placed.join(F.broadcast(first) if first.count() <= 10_000 else first, "key")
    nodes = nodes.select("key", (F.col("ordinal") - F.col("first")).alias("pos"), "hash", F.struct("id", "load").alias("load"))
    trees, roots = climb(nodes, config)
    trees, roots = trees.withColumnRenamed("top", "subroot"), roots.withColumnRenamed("top", "hash")
    tops = global_ordinal(roots, ["key"]).select(F.lit("").alias("key"), (F.col("ordinal") - 1).alias("pos"), "hash", F.col("key").alias("load"))
    over = climb(tops, config)[0].select(F.col("load").alias("key"), F.col("path").alias("over"), F.col("top").alias("root"))
    path = F.concat("path", "over").alias("path")
    return trees.join(over, "key").select(F.col("load.id").alias(order), F.col("load.load").alias("load"), F.col("hash").alias("leaf"), path, "subroot", "root")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof(path: Column) -> Column:
    """The siblings of a path, left to right and level by level, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def audit(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of ``docs``, and whether each row, some tampered with on the way, still leads to the root.

    Rows whose unsigned CRC-32 of the decimal id 7 divides are tampered with: 1 is added to ``n_chars``. Rows of a null id or a
    null ``n_chars`` stay as they are.
    """
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = leaf_digest([more if f == "n_chars" else F.col(f) for f in FIELDS])
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = manifest(docs, FIELDS, "doc_id", "lang", F.when(hit, changed))
    out = rows.withColumn("folded_root", fold(F.coalesce("load", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, coalesce('=' || lang, '-') AS k, {_sql_leaf("n_chars")} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND ({_CRC}) % 7 = 0 THEN {_sql_leaf("(n_chars + 1)")} ELSE {_sql_leaf("n_chars")} END AS sent
  FROM documents),
placed AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM leaves),
low AS (
  SELECT k, 0 AS lvl, pos, leaf AS node, n FROM placed
  UNION ALL
  SELECT k, lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY k, lvl, pos // 2, n),
subroots AS (
  SELECT k, node, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, pos, node, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY lvl, pos // 2, n),
steps AS (
  SELECT p.rid, l.lvl, p.pos >> l.lvl AS spot, s.node FROM placed p JOIN (SELECT DISTINCT k, lvl FROM low WHERE n > 1) l USING (k)
    LEFT JOIN low s ON s.k = l.k AND s.lvl = l.lvl AND s.pos = xor(p.pos >> l.lvl, 1)
  UNION ALL
  SELECT p.rid, 1000 + l.lvl, r.pos >> l.lvl, s.node FROM placed p JOIN subroots r USING (k) CROSS JOIN (SELECT DISTINCT lvl FROM high WHERE n > 1) l
    LEFT JOIN high s ON s.lvl = l.lvl AND s.pos = xor(r.pos >> l.lvl, 1)),
numbered AS (
  SELECT rid, spot, coalesce(node, '') AS node, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS step, lvl FROM steps),
proofs AS (
  SELECT rid, sha256(string_agg(node, '' ORDER BY lvl)) AS proof_sha256 FROM numbered GROUP BY rid),
folds AS (
  SELECT rid, 0::BIGINT AS step, sent AS h FROM placed
  UNION ALL
  SELECT f.rid, n.step, sha256(CASE WHEN n.spot % 2 = 0 THEN f.h || n.node ELSE n.node || f.h END) FROM folds f JOIN numbered n ON n.rid = f.rid AND n.step = f.step + 1),
folded AS (
  SELECT rid, arg_max(h, step) AS folded_root FROM folds GROUP BY rid)
SELECT p.doc_id, p.leaf, r.node AS subroot, t.node AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.node AS verified
FROM placed p JOIN subroots r USING (k) CROSS JOIN (SELECT node FROM high WHERE n = 1) t
  LEFT JOIN proofs q USING (rid) JOIN folded f USING (rid)
"""
