"""Merkle manifest of a dataset: per group a tree over ordered leaves, a root over the groups,
and for every leaf a witness that leads from it to the root.

Up to ``FAN`` consecutive nodes make a parent, the hash of their digests, until one node is left
(a last run may hold fewer, even one; a lone leaf is its own root). Trees are built by streaming
aligned append: leaves arrive in order and are appended to the open subtree. When a run is
complete, its nodes become siblings: every leaf below a node gets the node's siblings attached
to its partial witness, and the parent is appended one level up. Only open subtrees are held.

A group's leaves are cut into blocks of ``FAN ** BLOCK_LEVELS`` consecutive ones, so blocks are whole
subtrees of the tree and any task can append any block, however many leaves one group has. The
blocks' roots are appended in turn, in blocks of their own, until each group is left with its root,
and the groups' roots, ordered by group, likewise give the dataset's root. Then witnesses go
the way back: a block's own witness is the tail of its leaves' witnesses, and travels to its leaves as
one more row of the block.

Ranks of leaves come from a range partitioning by (group, order): the leaves of each partition and
group are counted, and the counts before them added. So no group, however hot, is sorted in one
task. Digests move through shuffles, texts don't. Ranked leaves and block roots are checkpointed, so
that a lost task meets the same ranks again.

A witness is a binary column: per level one byte (16 * run length + place in the run), followed by
the siblings' 32-byte digests, from the leaf's level up to the root. Digests are hashed as lowercase hex.

Defined cases: null columns have their own encoding; a null group is a group, the first one; rows
with null or equal order values are ordered by their digests (null first); rows that repeat are
leaves each; an empty table has no leaves and gives an empty result; of other columns only those
asked for are carried, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

FAN, BLOCK_LEVELS = 3, 7
#: Encoding of a null column.
NULL = "-"


def leaf_digest(columns: list[Column]) -> Column:
    """Digest (hex) of a row: per column its UTF-8 byte count, ``:`` and its text; null: ``-``."""
    parts = [F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")) for c in columns]
    return F.sha2(F.concat(*[F.coalesce(p, F.lit(NULL)) for p in parts]).cast("binary"), 256)


def node(digests: list[bytes]) -> bytes:
    """Digest of a run of nodes."""
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


class Appender:
    """Leaves appended to one block; ``levels`` high (None: until one node is left)."""

    def __init__(self, fan: int, levels: int | None, witnesses: bool):
        self.fan, self.levels, self.witnesses = fan, levels, witnesses
        self.open: list[list[tuple[bytes, int, int]]] = [[]]  # per level: (digest, first leaf, leaf after it) of the open run
        self.parts: list[list[bytes]] = []  # per leaf: its witness so far

    def append(self, digest: bytes) -> None:
        self.parts.append([])
        self._add(0, (digest, len(self.parts) - 1, len(self.parts)))

    def _add(self, level: int, member: tuple[bytes, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(member)
        if len(self.open[level]) == self.fan and level != self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The open run of ``level`` becomes a parent; its leaves' witnesses are extended."""
        run, self.open[level] = self.open[level], []
        if self.witnesses:
            for place, (_, first, after) in enumerate(run):
                more = bytes([16 * len(run) + place]) + b"".join([d for i, (d, _, _) in enumerate(run) if i != place])
                for leaf in range(first, after):
                    self.parts[leaf].append(more)
        self._add(level + 1, (node([d for d, _, _ in run]), run[0][1], run[-1][2]))

    def finish(self) -> tuple[bytes, list[bytes]]:
        """The block's root and its leaves' witnesses below it."""
        level = 0
        while True:
            above = any(self.open[level + 1:])
            if level == self.levels or (self.levels is None and not above and len(self.open[level]) == 1):
                break
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0], [b"".join(p) for p in self.parts]


def _append_blocks(fan: int, height: int, carried: list[str] | None):
    """Streams rows (g, block, pos, n, digest, tail, top, carried columns) sorted by (g, block, pos).

    Gives each block's root (g, pos, n, digest); or, with ``carried`` columns named, each row's
    witness (g, pos, digest, witness, top, carried columns). A block's first row, at pos -1, then
    brings its own witness (``tail``) and its group's root (``top``). A block is ``height`` levels
    high unless its group has no other: then it ends at one node."""
    names = ["g", "pos", "n", "digest"] if carried is None else ["g", "pos", "digest", "witness", "top", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, tail, top, rows, out, types = None, None, b"", None, [], [], []

        def close():
            if tree is None:
                return
            root, found = tree.finish()
            if carried is None:
                out.append((*key, -(-rows[0][0] // fan ** height), root))
            else:
                out.extend((key[0], r[1], r[2], w + tail, top, *r[3:]) for r, w in zip(rows, found))

        def flush():
            cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            types = [pa.string(), pa.int64(), pa.int64(), pa.binary()] if carried is None else \
                [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), *(b.schema.field(c).type for c in carried)]
            for g, block, pos, n, digest, up, above, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if (g, block) != key:
                    close()
                    if len(out) >= 4096:
                        yield flush()
                    key, tree, tail, top, rows = (g, block), None, b"", None, []
                if pos < 0:
                    tail, top = up, above
                    continue
                if tree is None:
                    tree = Appender(fan, height if n > fan ** height else None, carried is not None)
                tree.append(digest)
                if carried is not None or not rows:
                    rows.append((n, pos, digest, *rest))
        close()
        if out:
            yield flush()
    return run


def _blocks(items: DataFrame, carried: list[str], fan: int, height: int, tails: DataFrame | None) -> DataFrame:
    """Whole blocks in order, each in one partition, ``tails`` (g, pos, witness, top) first."""
    none = F.lit(None).cast("binary")
    rows = items.select("g", F.expr(f"pos div {fan ** height}").alias("block"), "pos", "n", "digest", none.alias("tail"),
                        none.alias("top"), *carried)
    if tails is not None:
        head = tails.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"),
                            none.alias("digest"), F.col("witness").alias("tail"), "top")
        rows = rows.unionByName(head, allowMissingColumns=True)
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "pos")


def _ranked(rows: DataFrame, order: list[Column], carried: list[str]) -> DataFrame:
    """``rows`` (g, digest, ...) with pos (rank within g) and n (rows of g), checkpointed."""
    placed = (rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
              .withColumn("_at", F.monotonically_increasing_id()).checkpoint())
    placed = placed.withColumn("_p", F.shiftright("_at", 33))  # the partition; the bits below count its rows
    held = placed.groupBy("g", "_p").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    group = Window.partitionBy("g")  # one row for each partition that holds the group
    held = held.select("g", "_p", "_first", F.sum("_c").over(group).alias("n"),
                       (F.sum("_c").over(group.orderBy("_p")) - F.col("_c")).alias("_before"))
    return (placed.join(held, ["g", "_p"])
            .select("g", (F.col("_before") + F.col("_at") - F.col("_first")).alias("pos"), "n", "digest", *carried).checkpoint())


def _append_up(items: DataFrame, fan: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Layers of nodes, each holding the block roots of the one before, and every group's root."""
    layers = []
    while True:
        layers.append(items)
        items = _blocks(items, [], fan, height, None).mapInArrow(
            _append_blocks(fan, height, None), "g string, pos long, n long, digest binary").checkpoint()
        if (items.agg(F.max("n")).first()[0] or 0) <= 1:
            return layers, items


def _extend_down(layers: list[DataFrame], tails: DataFrame | None, carried: list[str], fan: int, height: int) -> DataFrame:
    """Witnesses of the lowest layer, which has ``carried`` columns; ``tails`` are those of the groups' roots."""
    for items in reversed(layers):
        more = carried if items is layers[0] else []
        types = {f.name: f.dataType.simpleString() for f in items.schema.fields}
        tails = _blocks(items, more, fan, height, tails).mapInArrow(
            _append_blocks(fan, height, more),
            ", ".join(["g string", "pos long", "digest binary", "witness binary", "top binary", *(f"{c} {types[c]}" for c in more)]))
    return tails


def witnesses(leaves: DataFrame, group: str, order: str, digest: str, carry: tuple[str, ...] = (),
              fan: int = FAN, height: int = BLOCK_LEVELS) -> DataFrame:
    """The trees over ``leaves`` (``digest`` in hex), one per ``group``, and the tree over their roots
    (by group: null first, then bytewise).

    Returns pos (place within the group, from 0), leaf, subroot, root (hex), witness (binary) and the
    ``carry`` columns, which must not have those names."""
    if not 2 <= fan <= 15 or height < 1:
        raise ValueError("fan must be 2 to 15, blocks at least one level high")
    if clash := {"pos", "leaf", "subroot", "root", "witness"} & set(carry):
        raise ValueError(f"carried columns named like the result's: {sorted(clash)}")
    ensure_checkpoint_dir(leaves.sparkSession)
    held = [f"c{i}" for i in range(len(carry))]
    g = F.col(f"`{group}`")
    rows = leaves.select(F.when(g.isNull(), "").otherwise(F.concat(F.lit("="), g.cast("string"))).alias("g"),
                         F.unhex(F.col(f"`{digest}`")).alias("digest"), F.col(f"`{order}`").alias("o"),
                         *[F.col(f"`{c}`").alias(h) for c, h in zip(carry, held)])
    in_groups, subroots = _append_up(_ranked(rows, [F.col("o").asc_nulls_first(), F.col("digest")], held), fan, height)
    tops = _ranked(subroots.select(F.lit("").alias("g"), "digest", F.col("g").alias("c0")), [F.col("c0")], ["c0"])
    over_groups, root = _append_up(tops, fan, height)
    end = root.first()  # one row: the dataset's root
    known = _extend_down(over_groups, None, ["c0"], fan, height)
    known = known.select(F.col("c0").alias("g"), F.lit(0).cast("long").alias("pos"), "witness", F.col("digest").alias("top"))
    found = _extend_down(in_groups, known, held, fan, height)
    return found.select("pos", F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("top")).alias("subroot"),
                        F.lit(end.digest.hex() if end else None).alias("root"), "witness",
                        *[F.col(h).alias(c) for c, h in zip(carry, held)])


# ------------------------------------------------------------------ checking witnesses
def levels(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place in the run, siblings) of each level, from the leaf's up."""
    at = 0
    while at < len(witness):
        size, place = divmod(witness[at], 16)
        end = at + 1 + 32 * (size - 1)
        yield place, [witness[i:i + 32] for i in range(at + 1, end, 32)]
        at = end


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that ``leaf`` and its witness lead to."""
    for place, others in levels(witness):
        leaf = node([*others[:place], leaf, *others[place:]])
    return leaf


def audit(found: DataFrame, leaf: str, witness: str = "witness", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns with folded_root (of the hex digest in ``leaf``) and proof_sha256 (of all siblings
    in order, as hex text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots, proofs = [], []
            for d, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                roots.append(fold(bytes.fromhex(d), w).hex())
                proofs.append(hashlib.sha256("".join([x.hex() for _, others in levels(w) for x in others]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(roots, pa.string()), pa.array(proofs, pa.string())],
                                             names=[*b.schema.names[2:], "folded_root", "proof_sha256"])

    types = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "folded_root string", "proof_sha256 string"])
    return found.select(F.col(f"`{leaf}`").alias("_leaf"), F.col(f"`{witness}`").alias("_witness"),
                        *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by source; half of them are checked with their line ends deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(changed, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", leaf_digest([*row, F.col("text")]).alias("digest"), leaf_digest([*row, text]).alias("shown"))
    found = witnesses(leaves, "source", "doc_id", "digest", carry=("doc_id", "shown"))
    out = audit(found, "shown", keep=("doc_id", "leaf", "subroot", "root"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}

#: The same by recursion over levels; crc32 bit by bit (a byte is taken in, then eight shifts).
ORACLES = {"op13_merkle_manifest": """
WITH RECURSIVE marked AS (
  SELECT *, (list_reduce(list_concat([4294967295::BIGINT],
      flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) & 1) = 1 AS changed
  FROM documents),
row_text AS (
  SELECT doc_id, source, CASE WHEN changed THEN replace(text, chr(10), '') ELSE text END AS shown, text,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head
  FROM marked),
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS shown FROM row_text),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes AS (
  SELECT 0 AS level, g, pos, n, leaf AS digest FROM ranked
  UNION ALL
  SELECT level + 1, g, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY level, g, pos // 3, n),
subroots AS (
  SELECT g, digest AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
steps AS (
  SELECT a.level, a.g, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM nodes a JOIN nodes b ON a.level = b.level AND a.g = b.g AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
top_steps AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM tops a JOIN tops b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
walk AS (
  SELECT g, pos AS place, 0 AS level, pos, shown AS digest, '' AS proof FROM ranked
  UNION ALL
  SELECT w.g, w.place, w.level + 1, w.pos // 3, sha256(s.before || w.digest || s.after), w.proof || s.before || s.after
  FROM walk w JOIN steps s ON w.level = s.level AND w.g = s.g AND w.pos = s.pos),
climbed AS (SELECT g, place, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM walk GROUP BY g, place),
top_walk AS (
  SELECT c.g, c.place, 0 AS level, s.pos, c.digest, c.proof FROM climbed c JOIN subroots s ON c.g = s.g
  UNION ALL
  SELECT w.g, w.place, w.level + 1, w.pos // 3, sha256(s.before || w.digest || s.after), w.proof || s.before || s.after
  FROM top_walk w JOIN top_steps s ON w.level = s.level AND w.pos = s.pos),
ended AS (SELECT g, place, arg_max(digest, level) AS folded_root, arg_max(proof, level) AS proof FROM top_walk GROUP BY g, place)
SELECT r.doc_id, r.leaf, s.subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
FROM ranked r JOIN ended e ON r.g = e.g AND r.pos = e.place JOIN subroots s ON r.g = s.g CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
"""}
