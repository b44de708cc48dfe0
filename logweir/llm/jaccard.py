"""N-gram Jaccard join (operator 1): MinHash bands, then full shingle sets.

Texts with the same shingle set are one node. Bands of min-hashes put nodes that may be
similar into the same bucket; only buckets with two nodes go on. Signatures thin what shares a
bucket, the survivors' components are tiled, and inside a tile pair every two shingle sets
are compared in full. No pairs are written: a tile gives each node its number of links and
a spanning edge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9999
ROWS = 5
# Buckets up to this size are compared whole by signature, larger ones through leaders.
SMALL_BUCKET = 64
# Larger buckets are dealt to parts of about this many nodes.
SPLIT_BUCKET = 512
BLOCK_ROWS = 1 << 14
# Nodes and shingles of a tile; two tiles are held by a task.
TILE_NODES = 256
TILE_SHINGLES = 1 << 20
TASK_SHINGLES = 1 << 21
COLUMNS = 1 << 13

_EMPTY = 0


def band_count(similarity: float, recall: float, rows: int) -> int:
    """Bands needed for pairs at the similarity to share one with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = band_count(SIMILARITY, RECALL, ROWS)
HASHES = BANDS * ROWS
# Share of equal signature bytes: a pair at the similarity falls below PASS with a chance under
# 1e-5. NEAR and FAR serve leaders: whoever is like a follower of a leader is at least FAR
# from the leader, as the Jaccard distance is a metric.
PASS, NEAR, FAR = 0.6, 0.65, 0.3

_MULTIPLIERS = (
    np.random.default_rng(7).integers(1, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)
).astype(np.uint32)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of five words; one to four words are one
    shingle, no words none."""
    chunk = common.Chunk(texts)
    hashes, at = chunk.windows(SHINGLE)
    cuts = np.searchsorted(at, chunk.bounds)
    found = []
    for i, count in enumerate(chunk.counts):
        if count >= SHINGLE:
            found.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
        else:
            words = chunk.hashes[chunk.bounds[i] : chunk.bounds[i + 1]]
            found.append(common.hash_windows(words, max(count, 1)) ^ np.uint64(count))
    return found


def node_numbers(sets: list[np.ndarray]) -> np.ndarray:
    """A number for each non-empty shingle set, equal sets alike."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    sums = np.add.reduceat(common.mix(np.concatenate(sets) + np.uint64(1)), starts)
    nodes = common.mix(sums ^ sizes.astype(np.uint64)).astype(np.int64)
    nodes[nodes == _EMPTY] = 1
    return nodes


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node numbers, band hashes and signature bytes of non-empty shingle sets."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    nodes = node_numbers(sets)
    short = (flat >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(sets), HASHES), dtype=np.uint32)
    for i, factor in enumerate(_MULTIPLIERS):
        least[:, i] = np.minimum.reduceat(short * factor, starts)
    wide = least.astype(np.uint64).reshape(len(sets), BANDS, ROWS)
    bands = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS)).copy()
    for row in range(ROWS):
        bands = common.mix(bands * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, row])
    return nodes, bands.astype(np.int64), (common.mix(least) >> np.uint64(56)).astype(np.uint8)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()),
                     ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
_SIGNED_DDL = "doc_id bigint, node bigint, n_shingles bigint, bands array<bigint>, sig binary"


def _sign(columns: list) -> dict:
    texts, ids = columns
    sets = shingle_sets(texts)
    sizes = np.array([len(s) for s in sets])
    nodes = np.full(len(sets), _EMPTY, dtype=np.int64)
    bands: list = [None] * len(sets)
    sigs: list = [None] * len(sets)
    full = np.flatnonzero(sizes)
    if len(full):
        nodes[full], hashes, bytes_ = signatures([sets[i] for i in full])
        for at, i in enumerate(full):
            bands[i], sigs[i] = hashes[at], bytes_[at].tobytes()
    return {"doc_id": ids, "node": nodes, "n_shingles": sizes, "bands": bands, "sig": sigs}


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each component of a symmetric boolean matrix."""
    roots = np.arange(len(linked))
    while True:
        reach = np.where(linked, roots[None, :], len(linked)).min(axis=1)
        lower = np.minimum(roots, reach)
        lower = lower[lower]
        if (lower == roots).all():
            return roots
        roots = lower


class _Bucket:
    """Members of one bucket, or of a part of one, as they stream by in blocks.

    The leaders of a part hang under ``hub``, a number that stands for the whole bucket: so
    parts need not be compared with each other, and whoever is alike is connected.
    """

    def __init__(self, hub: int | None = None):
        self.leaders: list[tuple[int, np.ndarray]] = []
        self.hub = hub

    def block(self, nodes: np.ndarray, sigs: np.ndarray, whole: bool) -> list[tuple]:
        if whole and self.hub is None and len(nodes) <= SMALL_BUCKET:
            alike = (sigs[:, None, :] == sigs[None, :, :]).mean(axis=2) >= PASS
            roots = _local_roots(alike)
            hung = np.flatnonzero(roots != np.arange(len(nodes)))
            return [(nodes[hung], nodes[roots[hung]])]
        edges = []
        for node, sig in self.leaders:
            nodes, sigs = self._follow(node, sig, nodes, sigs, edges)
        while len(nodes):
            node, sig = nodes[0], sigs[0]
            self.leaders.append((node, sig))
            if self.hub is not None:
                edges.append((np.array([node]), np.array([self.hub])))
            nodes, sigs = self._follow(node, sig, nodes[1:], sigs[1:], edges)
        return edges

    @staticmethod
    def _follow(node, sig, nodes, sigs, edges):
        if not len(nodes):
            return nodes, sigs
        alike = (sigs == sig).mean(axis=1)
        linked = nodes[alike >= FAR]
        edges.append((linked, np.full(len(linked), node)))
        return nodes[alike < NEAR], sigs[alike < NEAR]


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate edges of buckets; rows come sorted by bucket and part."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    current, state, held = None, _Bucket(), []

    def flush(whole: bool):
        if not held:
            return
        nodes = np.concatenate([h[0] for h in held])
        sigs = np.concatenate([h[1] for h in held])
        held.clear()
        yield from state.block(nodes, sigs, whole)

    def packed(edges):
        edges = [e for e in edges if len(e[0])]
        if edges:
            yield pa.RecordBatch.from_pydict(
                {"a": np.concatenate([e[0] for e in edges]),
                 "b": np.concatenate([e[1] for e in edges])}, schema=schema)

    for batch in batches:
        out = []
        buckets = batch.column("bucket").to_numpy()
        parts = batch.column("part").to_numpy()
        split = batch.column("split").to_numpy(zero_copy_only=False)
        nodes = batch.column("node").to_numpy()
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(
            len(nodes), -1)
        new = (buckets[1:] != buckets[:-1]) | (parts[1:] != parts[:-1])
        cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [len(buckets)]))
        for first, last in zip(cuts[:-1], cuts[1:]):
            if first == last:
                continue
            if (buckets[first], parts[first]) != current:
                out += flush(whole=not state.leaders)
                current = (buckets[first], parts[first])
                state = _Bucket(int(buckets[first]) if split[first] else None)
            held.append((nodes[first:last], sigs[first:last]))
            if sum(len(h[0]) for h in held) >= BLOCK_ROWS:
                out += flush(whole=False)
        yield from packed(out)
    yield from packed(flush(whole=not state.leaders))


def candidate_edges(signed: DataFrame) -> DataFrame:
    """Edges between nodes that share a band and look alike by signature."""
    banded = signed.where(f"node <> {_EMPTY}").select("node", F.explode("bands").alias("bucket"))
    shared = common.saved(
        banded.groupBy("bucket").agg(
            F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n"))
        .where("low <> high").select(
            F.col("bucket").alias("shared"),
            F.ceil(F.col("n") / SPLIT_BUCKET).cast("int").alias("parts")), "jaccard-buckets")
    members = banded.join(shared, F.col("bucket") == F.col("shared")).select(
        "bucket", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"),
        (F.col("parts") > 1).alias("split")).distinct()
    sigs = signed.where(f"node <> {_EMPTY}").groupBy(F.col("node").alias("sig_of")).agg(
        F.first("sig").alias("sig"))
    rows = members.join(sigs, F.col("node") == F.col("sig_of")).select(
        "bucket", "part", "split", "node", "sig")
    width = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ["bucket", "part"]
    sorted_rows = rows.repartition(width, *keys).sortWithinPartitions(*keys, "node")
    return sorted_rows.mapInArrow(_bucket_edges, "a bigint, b bigint").distinct()


def _common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 blocks over the shared shingles."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    column = np.cumsum(new) - 1
    many = np.bincount(column)[column] > 1
    rows, columns = owner[order[many]], column[many]
    _, columns = np.unique(columns, return_inverse=True)
    count = np.zeros((len(sets), len(sets)))
    width = int(columns[-1]) + 1 if len(columns) else 0
    for first in range(0, width, COLUMNS):
        a, b = np.searchsorted(columns, [first, first + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, width - first)), dtype=np.float32)
        block[rows[a:b], columns[a:b] - first] = 1
        count += block @ block.T
    return count


_LINK = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("n_links", pa.int64())])


def _compare(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        """Links inside the tile pairs of a task."""
        groups: dict[tuple, list] = {}
        frame = table.select(["comp", "i", "j", "tile", "node", "copies"]).to_pandas()
        shingles = table.column("shingles").to_pylist()
        for at, key in enumerate(zip(frame["comp"], frame["i"], frame["j"])):
            groups.setdefault(key, []).append(at)
        out = []
        for (_, i, j), places in groups.items():
            part = frame.iloc[places].reset_index(drop=True)
            part = part[~part["node"].duplicated()]
            if len(part) < 2:
                continue
            sets = [np.frombuffer(shingles[places[k]], np.uint64) for k in part.index]
            nodes = part["node"].to_numpy()
            sizes = np.array([len(s) for s in sets], dtype=np.float64)
            both = _common_counts(sets)
            linked = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if i != j:
                tile = part["tile"].to_numpy()
                linked &= tile[:, None] != tile[None, :]
            roots = _local_roots(linked)
            weights = linked @ part["copies"].to_numpy()
            hit = np.flatnonzero(linked.any(axis=1))
            out.append(pa.table({"node": nodes[hit], "root": nodes[roots[hit]],
                                 "n_links": weights[hit]}, schema=_LINK))
        return pa.concat_tables(out) if out else _LINK.empty_table()

    return run


_SET_OF = pa.schema([("doc_id", pa.int64()), ("set_node", pa.int64()), ("shingles", pa.binary())])
_SET_OF_DDL = "doc_id bigint, set_node bigint, shingles binary"


def _sets_of(columns: list) -> dict | None:
    texts, ids = columns
    sets = shingle_sets(texts)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return None
    sets = [sets[i] for i in full]
    return {"doc_id": ids.take(pa.array(full)), "set_node": node_numbers(sets),
            "shingles": [s.tobytes() for s in sets]}


def jaccard_join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """Each document with ``class_id``, ``copy_id`` and ``n_links``.

    Two documents are linked when the sets of their five-word runs have a Jaccard similarity
    of at least ``similarity`` (>= 0.8, for which the bands are chosen: a pair at 0.8 is missed
    with a chance of 1e-4, a closer one less). ``n_links`` counts the linked documents, copies
    included; ``copy_id`` is the smallest id with the same set, ``class_id`` the smallest id in
    the connected group.

    A text of one to four words is one shingle; null, empty and blank texts have none and stay
    alone. Rows without an id stay alone, with null class and copy, and link nobody. Rows that
    share an id are each compared. An empty table gives no rows. Only the two named columns
    are read, so other columns cannot clash.
    """
    frame = docs.select(F.col(key).cast("long").alias("doc_id"), common.as_bytes(text).alias("t"))
    signed = common.saved(
        frame.where("doc_id IS NOT NULL").mapInArrow(
            common.by_chunk(_sign, ["t", "doc_id"], _SIGNED), _SIGNED_DDL), "jaccard-signed")
    nodes = common.saved(
        signed.where(f"node <> {_EMPTY}").groupBy("node").agg(
            F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"),
            F.max("n_shingles").alias("n_shingles")), "jaccard-nodes")
    grouped = components(candidate_edges(signed)).withColumnRenamed("root", "comp")
    grouped = common.saved(grouped.join(nodes, "node"), "jaccard-candidates")

    # Tiles of a component: enough for its nodes and for its shingles.
    tiles = grouped.groupBy("comp").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / TILE_NODES), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)
    ).cast("int").alias("tiles"))
    tiled = common.saved(
        grouped.join(tiles, "comp").withColumn(
            "tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")), "jaccard-tiles")
    work = tiled.agg(F.sum(F.col("n_shingles") * F.col("tiles"))).first()[0] or 0
    tasks = max(-(-work // TASK_SHINGLES), 2 * docs.sparkSession.sparkContext.defaultParallelism)
    wanted = tiled.select(F.col("first").alias("set_of"), "node", "comp", "tiles", "tile", "copies")
    sets = frame.join(
        wanted.select("set_of").distinct(), F.col("doc_id") == F.col("set_of"), "left_semi"
    ).mapInArrow(common.by_chunk(_sets_of, ["t", "doc_id"], _SET_OF), _SET_OF_DDL)
    pairs = (
        sets.join(wanted, F.col("set_node") == F.col("node"))
        .where("doc_id = set_of")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
        .withColumn("task", F.pmod(F.xxhash64("comp", "i", "j"), F.lit(tasks)).cast("int"))
        .select("task", "comp", "i", "j", "tile", "node", "copies", "shingles")
    )
    found = common.saved(
        pairs.repartition(tasks, "task").groupBy("task").applyInArrow(
            _compare(similarity), "node bigint, root bigint, n_links bigint"), "jaccard-links")

    links = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (
        nodes.join(links, "node", "left").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    least = named.groupBy("root").agg(F.min("first").alias("class_id"))
    info = common.saved(
        named.join(least, "root").select(
            F.col("node").alias("info_of"), "class_id", F.col("first").alias("copy_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "jaccard-classes")
    rows = signed.select("doc_id", "node").join(info, F.col("node") == F.col("info_of"), "left")
    alone = frame.where("doc_id IS NULL").select(
        "doc_id", F.lit(None).cast("long").alias("class_id"),
        F.lit(None).cast("long").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")).unionByName(alone)


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose group holds a smaller id.

    Rows without an id stay. Rows that share an id stay or go together, equal texts of one id
    once.
    """
    found = jaccard_join(docs, key, text).groupBy(F.col("doc_id").alias("judged_id")).agg(
        F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("rows_of_id"))
    # Only ids that go, or of which one row may go, are joined: the fewer there are, the less
    # has to be shuffled, and where Spark finds their table small, no text is.
    verdicts = common.saved(
        found.where("class_id <> judged_id OR rows_of_id > 1"), "jaccard-verdicts")
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(key).cast("long").alias("id_of_row"))
    joined = whole.join(verdicts, F.col("id_of_row") == F.col("judged_id"), "left")
    stays = joined.where("judged_id IS NULL OR class_id = judged_id")
    single = stays.where("judged_id IS NULL").select("row")
    several = stays.where("rows_of_id > 1").withColumn("words", F.xxhash64(F.col("row")[text]))
    return single.unionByName(
        several.dropDuplicates(["id_of_row", "words"]).select("row")).select("row.*")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(common.table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
shingles AS (
  SELECT DISTINCT rid, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM docs)),
sizes AS (SELECT rid, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS node
          FROM shingles GROUP BY rid),
nodes AS (SELECT node, min(doc_id) AS first, min(rid) AS rep, count(*) AS copies, any_value(n) AS n
          FROM sizes JOIN docs USING (rid) GROUP BY node),
of_nodes AS (SELECT node, s FROM shingles JOIN nodes ON rid = rep),
shared AS (SELECT a.node AS x, b.node AS y, count(*) AS k FROM of_nodes a JOIN of_nodes b
         ON a.s = b.s AND a.node <> b.node GROUP BY ALL),
links AS (SELECT x, y, b.copies FROM shared JOIN nodes a ON a.node = x JOIN nodes b ON b.node = y
          WHERE 5 * k >= 4 * (a.n + b.n - k)),
reach AS (
  SELECT node, node AS other FROM nodes
  UNION
  SELECT r.node, l.y FROM reach r JOIN links l ON r.other = l.x),
classes AS (SELECT r.node, min(n.first) AS class_id
            FROM reach r JOIN nodes n ON n.node = r.other GROUP BY r.node),
counts AS (SELECT x AS node, sum(copies) AS links FROM links GROUP BY x)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n.first, doc_id) AS copy_id,
  coalesce(coalesce(links, 0) + copies - 1, 0)::BIGINT AS n_links
FROM docs LEFT JOIN sizes s USING (rid) LEFT JOIN nodes n ON n.node = s.node
LEFT JOIN classes c ON c.node = s.node LEFT JOIN counts k ON k.node = s.node
UNION ALL
SELECT doc_id, NULL, NULL, 0 FROM documents WHERE doc_id IS NULL
"""
