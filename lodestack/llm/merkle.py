"""A Merkle manifest of a table: leaves, a node store on disk, and a checked proof for every row.

A row's leaf is the sha256 of its columns (``-`` for null, else byte count, ``:``, value). Of each language leaves ascend by id;
every two consecutive nodes become one (the last alone, if their number is odd) until one remains, the subroot. Subroots, ordered
by language (null first, by bytes), likewise give the root.

The store lies outside memory. Only ids and digests are shuffled, never texts. Leaves are range-sorted into runs, numbered by the
counts of the sorted parts, and dealt into aligned runs of ``2 ** STEP`` positions, so that ``STEP`` levels of a run need no other
run. Each task streams its sorted runs and writes their nodes to Parquet parted by level; the next step reads the last level that
was written. Proofs go the other way: a merge of the stored nodes of a run, sorted by coordinate (language, run, level, position),
with the proof of the node above it gives the proofs of its nodes, and so down to the leaves. A run is at most ``2 ** (STEP + 1)``
digests, however large a language is, and a step divides the number of nodes by ``2 ** STEP``: ten billion rows take three.

Results: a null id sorts first and is not tampered with; rows of one id go by their leaf, repeated rows by any order, as their
leaves are equal. An empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: Levels that one pass over sorted runs computes; a run has 2 ** STEP nodes at its lowest level.
STEP = 10
#: Rows of an Arrow batch that a task gives out.
_BATCH = 4_096
#: grp: "" for null, "=" and the value else, which sorts null first. n: leaves of the group. own: columns that only leaves have.
_NODE = "grp string, level int, pos bigint, n bigint, digest binary, id bigint, changed binary"


def _h(*parts: bytes) -> bytes:
    """sha256 of the digests' hex texts."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def height(n: int) -> int:
    """Levels above n leaves."""
    return max(0, (n - 1).bit_length())


def _field(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    """The leaf of the columns in this order, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(_field(c) for c in row.values())).cast("binary"), 256))


def fold(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of this and the next ``levels`` levels."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def climb(digest: bytes, siblings: list[bytes], pos: int, n: int, levels: int) -> bytes:
    """The node ``levels`` levels above position ``pos`` of n, from a node and its siblings (those that there are, lowest first)."""
    left = iter(siblings)
    for _ in range(levels):
        if n <= 1:
            break
        if pos & 1:
            digest = _h(next(left), digest)
        else:
            digest = _h(digest, next(left)) if pos + 1 < n else _h(digest)
        pos, n = pos >> 1, (n + 1) >> 1
    return digest


def numbered(leaves: DataFrame) -> DataFrame:
    """``pos`` from 0 and ``n`` (their number) in each group of leaves (grp, key, digest, …), ordered by key, then digest.

    Range-sorted parts are written with a number that names the part and the place in it; the counts of (part, group) give where each
    starts. The order ends with a number of its own, so that equal rows do not meet in one part. ``leaves`` is read more than once.
    """
    by = ["grp", "key", "digest", "uid"]
    sorted_runs = leaves.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    runs = cut(sorted_runs.withColumn("at", F.monotonically_increasing_id()).drop("uid"), "runs").withColumn("part", F.shiftright("at", 33))
    counts = runs.groupBy("grp", "part").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("grp", "part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    return runs.join(starts, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("_shift")).drop("at", "part", "_shift")


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of sorted batches, as dicts, one iterator for each run of equal values of ``by``."""
    return groupby((row for batch in batches for at in range(0, batch.num_rows, 1_024) for row in batch.slice(at, 1_024).to_pylist()), key=lambda r: tuple(r[c] for c in by))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_STORED = pa.schema([("grp", pa.string()), ("level", pa.int32()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("id", pa.int64()), ("changed", pa.binary())])
_ABOVE = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("siblings", pa.binary())])
_PROOF = pa.schema([("grp", pa.string()), ("id", pa.int64()), ("leaf", pa.binary()), ("siblings", pa.binary()), ("subroot", pa.binary()), ("folded", pa.binary())])
#: height(n) in SQL, but 1 for a single leaf, which has a step of its own too.
_HEIGHT = "length(bin(n - 1))"


class Store:
    """Nodes of many trees in Parquet parted by level, and the number of levels of the tallest tree."""

    def __init__(self, spark, path: str, tallest: int):
        self.spark, self.path, self.tallest = spark, path, tallest

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(_NODE).parquet(self.path)

    def tops(self) -> DataFrame:
        """(grp, n, digest) of the single node that remains of each tree."""
        return self.nodes().where(f"pos = 0 and level = if(n <= 1, 0, {_HEIGHT})").select("grp", "n", "digest")


def build(leaves: DataFrame, name: str) -> Store:
    """The store of the trees over leaves (grp, pos, n, digest, id, changed)."""
    spark = leaves.sparkSession
    path = f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"
    leaves.select("grp", F.lit(0).alias("level"), "pos", "n", "digest", "id", "changed").write.mode("append").partitionBy("level").parquet(path)
    largest = Store(spark, path, 0).nodes().agg(F.max("n")).first()[0]
    store = Store(spark, path, height(largest or 0))

    def upward(base: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def nodes() -> Iterator[tuple]:
                for (grp, number, n), rows in _runs(batches, ("grp", "run", "n")):
                    made = fold([r["digest"] for r in rows], min(STEP, height(n) - base))
                    for up, level in enumerate(made[1:], 1):
                        start = number << (STEP - up)
                        yield from ((grp, base + up, start + i, n, digest, None, None) for i, digest in enumerate(level))

            yield from _batches(nodes(), _STORED)

        return run

    for base in range(0, store.tallest, STEP):
        lowest = store.nodes().where(f"level = {base} and n > 1 and level < {_HEIGHT}").withColumn("run", F.shiftright("pos", STEP)).select("grp", "run", "pos", "n", "digest")
        runs = lowest.repartition("grp", "run").sortWithinPartitions("grp", "run", "pos")
        runs.mapInArrow(upward(base), _NODE).write.mode("append").partitionBy("level").parquet(path)
    return store


def proofs(store: Store, above: DataFrame) -> DataFrame:
    """(grp, id, leaf, siblings, subroot, folded) of every leaf.

    ``above``: (grp, siblings, pos, n, digest) of each tree's top, with its place in the tree over it. siblings: 32 bytes each, from the
    leaf upwards, those of the upper tree last. folded: the root that the leaf, or what it has been ``changed`` into, and the siblings give.
    """

    def downward(base: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def answers() -> Iterator[tuple]:
                for (grp, number), rows in _runs(batches, ("grp", "run")):
                    top = next(rows)  # the proof of the node above the run sorts first, then the run's nodes by level and position
                    levels: dict[int, list[bytes]] = {}
                    lowest, n = [], 1
                    for r in rows:
                        n = r["n"]
                        levels.setdefault(r["level"] - base, []).append(r["digest"])
                        if r["level"] == base:
                            lowest.append((r["digest"], r["id"], r["changed"]))
                    for place, (digest, own, changed) in enumerate(lowest):
                        pos, beside = (number << STEP) + place, [(up, (place >> up) ^ 1) for up in range(min(STEP, height(n) - base))]
                        siblings = b"".join(levels[up][at] for up, at in beside if at < len(levels[up])) + top["siblings"]
                        if base:
                            yield grp, pos, siblings
                            continue
                        path = [siblings[i : i + 32] for i in range(0, len(siblings), 32)]
                        inside = len(path) - top["top_siblings"]
                        subroot = climb(digest if changed is None else changed, path[:inside], pos, n, height(n))
                        yield grp, own, digest, siblings, top["top"], climb(subroot, path[inside:], top["top_pos"], top["top_n"], height(top["top_n"]))

            yield from _batches(answers(), _ABOVE if base else _PROOF)

        return run

    ends = above.select("grp", "siblings", F.col("pos").alias("top_pos"), F.col("n").alias("top_n"), F.col("digest").alias("top"), F.floor(F.octet_length("siblings") / 32).cast("int").alias("top_siblings"))
    known = None
    for base in [*range(0, store.tallest, STEP)][::-1] or [0]:
        nodes = store.nodes().where(f"level >= {base} and level < {base + STEP} and level < {_HEIGHT} and {base} < {_HEIGHT}")
        nodes = nodes.withColumn("run", F.expr(f"shiftright(pos, {STEP} - (level - {base}))"))
        # The proof above a run: that of the tree's top where the tree ends here, else that of the run's own top, found a step before.
        ending = nodes.where(f"level = {base} and pos = 0 and n <= {1 << (base + STEP)}L").select("grp").join(ends, "grp").withColumn("run", F.lit(0).cast("bigint"))
        over = ending if known is None else ending.unionByName(known.withColumnRenamed("pos", "run").join(ends.drop("siblings"), "grp"))
        rows = nodes.unionByName(over, allowMissingColumns=True)
        merged = rows.repartition("grp", "run").sortWithinPartitions("grp", "run", F.col("level").asc_nulls_first(), "pos")
        schema = "grp string, pos bigint, siblings binary" if base else "grp string, id bigint, leaf binary, siblings binary, subroot binary, folded binary"
        known = cut(merged.mapInArrow(downward(base), schema), "proofs")
    return known


def audit(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered_col: str = "n_chars", every: int = 7) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified, siblings) of every row; siblings is the proof, from the leaf upwards.

    ``folded_root`` comes from the row's leaf and its siblings, the leaf of a row whose id's crc32 ``every`` divides being that of the
    row with one added to ``tampered_col``: such a row is found out, as ``verified`` is whether the root is met.
    """
    row = {c: F.col(c) for c in columns}
    added = (F.col(tampered_col).cast("decimal(20,0)") + 1).cast("string")
    tampered = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, F.lit(False)) & F.col(tampered_col).isNotNull()
    group, own = F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit("")), F.col(id_col).cast("long")
    leaves = cut(docs.select(group.alias("grp"), own.alias("id"), own.alias("key"), leaf(row).alias("digest"), F.when(tampered, leaf(row | {tampered_col: added})).alias("changed")), "leaves")
    trees = build(numbered(leaves), "nodes")
    subroots = cut(trees.tops().select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest"), "subroots")
    upper = cut(numbered(subroots).withColumns({"id": F.col("pos"), "changed": F.lit(None).cast("binary")}), "upper_leaves")
    over = build(upper, "upper")
    root = over.tops().select("grp", F.lit(b"").alias("siblings"), F.lit(0).cast("bigint").alias("pos"), F.lit(1).cast("bigint").alias("n"), "digest")
    above = proofs(over, root).select("id", "siblings").join(upper.select(F.col("key").alias("grp"), "id", "n", "digest"), "id").withColumnRenamed("id", "pos")
    top = root.select("digest").first()  # one digest
    text = lambda c: F.lower(F.hex(c))
    root_hex = F.lit(top[0].hex() if top else None).cast("string")
    return proofs(trees, above).select(
        F.col("id").alias(id_col), text("leaf").alias("leaf"), text("subroot").alias("subroot"), root_hex.alias("root"), F.sha2(text("siblings").cast("binary"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"), (text("folded") == root_hex).alias("verified"), text("siblings").alias("siblings"),
    )


def oracle_sql() -> str:
    """The same in DuckDB, for unique rows."""
    field = lambda c: f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"
    whole = lambda n: f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field(n)} || {field('text')})"
    up = lambda name, start: f"""{name} AS ({start} UNION ALL SELECT g, l + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, l, n, pos // 2)"""
    # A node's parent from its own value x: its sibling on its left, on its right, or none.
    climb = lambda name, start, nodes: f"""{name} AS ({start} UNION ALL
        SELECT r, c.g, c.l + 1, c.pos // 2, c.x_next, c.proof || coalesce(c.h, '') FROM (
            SELECT c.*, s.h, sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.x ELSE c.x || coalesce(s.h, '') END) AS x_next
            FROM {name} c JOIN {nodes} own ON own.g = c.g AND own.l = c.l AND own.pos = c.pos AND own.n > 1 LEFT JOIN {nodes} s ON s.g = c.g AND s.l = c.l AND s.pos = xor(c.pos, 1)) c)"""  # noqa: E731
    return f"""
    WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(i))),
    d AS (SELECT row_number() OVER () AS r, coalesce('=' || lang, '') AS g, doc_id, {whole('n_chars')} AS leaf, {whole('n_chars::HUGEINT + 1')} AS changed, n_chars,
            xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::INT]))) AS h FROM documents, crc),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
    {up('nodes(g, l, pos, n, h)', 'SELECT g, 0, pos, n, leaf FROM leaves').replace('FROM nodes(g, l, pos, n, h)', 'FROM nodes')},
    tops AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
    {up('upper(g, l, pos, n, h)', "SELECT '', 0, pos, n, h FROM tops").replace('FROM upper(g, l, pos, n, h)', 'FROM upper')},
    {climb('c1(r, g, l, pos, x, proof)', "SELECT r, g, 0, pos, CASE WHEN h % 7 = 0 AND n_chars IS NOT NULL THEN changed ELSE leaf END, '' FROM leaves", 'nodes').replace('FROM c1(r, g, l, pos, x, proof)', 'FROM c1')},
    last1 AS (SELECT r, max_by(x, l) AS x, max_by(proof, l) AS proof FROM c1 GROUP BY r),
    {climb('c2(r, g, l, pos, x, proof)', "SELECT r, '', 0, t.pos, x, proof FROM last1 JOIN leaves USING (r) JOIN tops t ON t.g = leaves.g", 'upper').replace('FROM c2(r, g, l, pos, x, proof)', 'FROM c2')},
    last2 AS (SELECT r, max_by(x, l) AS x, max_by(proof, l) AS proof FROM c2 GROUP BY r)
    SELECT leaves.doc_id, leaves.leaf, t.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = u.h AS verified
    FROM leaves JOIN last2 USING (r) JOIN tops t ON t.g = leaves.g, upper u WHERE u.n = 1"""
