"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``tables`` short sketches (``depth`` minimum hashes each) are computed per
document; every pair (i, j) of a sketch of the first and one of the second collection is one table
key, so tables ** 2 keys cost only 2 * tables * depth minimum hashes. Two documents of similarity s
meet if each collection agrees somewhere: (1 - (1 - s ** depth) ** tables) ** 2, which is 0.9999 at
s = 0.8 for the defaults, and 2e-4 at s = 0.1.

Documents with equal shingle sets are one class, found by a digest of the set; only classes enter
the tables. Links are confirmed on whole sets. The result is one row per document.

In each table key the smallest class is the pivot; all others are compared with it, first each with
its smallest pivot, then with the others where the two are not yet in one component. True copies of
one text are one component by then. What is left are keys in which several components meet without a
confirmed link yet (copies edited too much, chance meetings), and there only documents that share
such a key are compared:

- in a key of at most ``few`` documents, each two of different components, once whatever the number
  of their keys: a number of pairs in proportion to the chance meetings;
- in a larger key, the components that share it with its largest one, their hub. The documents
  outside a hub are compared with it and with each other ``block`` by ``block`` at a time, by counting
  common shingles of all pairs of two blocks at once. Hubs are not chained into larger groups.

So every pair that meets in the tables is compared or already connected, and no key's group is ever
expanded into all its pairs.

Scale: shuffled are 16-byte keys (tables ** 2 per class) twice, one pass of the texts of candidates,
and their sets (6 bytes a shingle) per comparison. A key's pivot is a minimum, combined before the
shuffle; the join that brings it to the key's documents is split by adaptive execution where a key
is hot. Every step is written to shared space, and deleted when the components are known.

Cases: null text, empty text and text without words have no shingles and stay alone; a text of one
word has one shingle; very long texts are read whole; ties (several pivots, hubs of one size) go to
the smallest or largest identifier; rows with a null identifier stay alone, with a null component,
and are kept; rows with one identifier are one document, and ``drop_near_duplicates`` keeps one of
them; an identifier must be an integer, text that is no number fails; an empty table gives an empty
result; other columns are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.llm.common import SQL_LOWER, Vocabulary, bytes_of, materialize, mix64, settle, slices, table
from pairweave.operators.components import connect

_M = np.uint64(0x9E3779B97F4A7C15)
_PLANES = 6


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``width``-word shingles."""
    vocabulary = Vocabulary()
    ids = [vocabulary.encode([] if t is None else t.lower().split()) for t in texts]
    hashes = word_hashes(vocabulary.words())
    out = []
    for own in ids:
        h = hashes[own]
        n = min(width, len(h))
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        rolled = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            rolled = mix64(rolled * _M + h[k : len(h) - n + 1 + k])
        out.append(np.unique(rolled))
    return out


def _sketches(sets: list[np.ndarray], tables: int, depth: int) -> np.ndarray:
    """Document x (2 * tables) sketches; the sets must not be empty."""
    joined = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    factors = mix64(np.arange(1, 2 * tables * depth + 1, dtype=np.uint64) * _M) | np.uint64(1)
    out = np.zeros((len(sets), 2 * tables), np.uint64)
    for k, f in enumerate(factors):
        least = np.minimum.reduceat(mix32(joined * f), starts)
        out[:, k // depth] = mix64(out[:, k // depth] * _M + least + np.uint64(k))
    return out


def mix32(a: np.ndarray) -> np.ndarray:
    """Fold the high half into the low one, so that minima depend on all bits."""
    return (a ^ (a >> np.uint64(32))) * _M


def _encode(s: np.ndarray) -> bytes:
    """The top 6 bytes of sorted 64-bit hashes, as byte planes."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8).T[:1:-1].tobytes()


def _decode(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(_PLANES, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 2:] = planes[::-1].T
    return out.view("<u8").ravel()


def sketch(docs: DataFrame, width: int, tables: int, depth: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and both collections of sketches (null for empty sets)."""
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for piece in slices(part):
                sets = shingle_sets(bytes_of(piece.column("text")), width)
                some = [s for s in sets if len(s)]
                made = iter(_sketches(some, tables, depth).view(np.int64).tolist() if some else [])
                rows = [next(made) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([None if r is None else r[:tables] for r in rows], out.field("a").type),
                        pa.array([None if r is None else r[tables:] for r in rows], out.field("b").type),
                    ],
                    schema=out,
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, a array<long>, b array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, s): the sets of the documents in ``wanted`` (node)."""
    out = pa.schema([("node", pa.int64()), ("s", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for piece in slices(part):
                sets = shingle_sets(bytes_of(piece.column("text")), width)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(map(_encode, sets), pa.binary())], schema=out)

    chosen = docs.select("doc_id", "text").join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return materialize(chosen.mapInArrow(run, "node long, s binary"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for pairs (a, b): whether 100 * intersection >= percent * union."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for part in parts:
            linked = []
            for x, y in ((x.as_py(), y.as_py()) for x, y in zip(part.column("sa"), part.column("sb"), strict=True)):
                if held[0] != x:
                    held = (x, _decode(x))
                lo, hi = sorted((len(x), len(y)))
                if 100 * lo < percent * hi:
                    linked.append(False)
                    continue
                a, b = held[1], _decode(y)
                both = np.concatenate((a, b))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked, pa.bool_())], schema=out)

    of = {x: sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab"}
    both = pairs.join(of["b"], "b").join(of["a"], "a").select("a", "b", "sa", "sb")
    return materialize(both.mapInArrow(run, "a long, b long, linked boolean"))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``."""
    na, nb = len(a), len(b)
    out = np.zeros(na * nb, np.int64)
    common = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)

    def postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owners ordered by shingle, the shingle of each, and where each shingle's owners begin."""
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, flat).clip(max=len(common) - 1)
        held = np.flatnonzero(common[at] == flat)
        order = held[np.argsort(at[held], kind="stable")]
        return owner[order], at[order], np.searchsorted(at[order], np.arange(len(common) + 1))

    if not len(common):
        return out.reshape(na, nb)
    own_a, at_a, from_a = postings(a)
    own_b, at_b, from_b = postings(b)
    ca, cb = np.diff(from_a), np.diff(from_b)
    dense = ca * cb * 64 > na * nb
    number = np.cumsum(dense) - 1
    for first in range(0, int(dense.sum()), 4096):  # frequent shingles by a product of 0/1 matrices
        ma, mb = (np.zeros((n, 4096), np.float32) for n in (na, nb))
        for m, own, at in ((ma, own_a, at_a), (mb, own_b, at_b)):
            here = dense[at] & (number[at] >= first) & (number[at] < first + 4096)
            m[own[here], number[at[here]] - first] = 1
        out += np.rint(ma @ mb.T).astype(np.int64).ravel()
    rare = np.flatnonzero(~dense)
    cuts = np.searchsorted(np.cumsum(ca[rare] * cb[rare]), np.arange(0, int((ca[rare] * cb[rare]).sum()) + 1, 500_000), "right")
    for part in np.split(rare, cuts[1:]):  # others by listing the pairs of owners
        sizes = ca[part] * cb[part]
        if not sizes.sum():
            continue
        which = np.repeat(np.arange(len(part)), sizes)
        k = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        x = own_a[from_a[part][which] + k // cb[part][which]]
        y = own_b[from_b[part][which] + k % cb[part][which]]
        out += np.bincount(x * nb + y, minlength=na * nb)
    return out.reshape(na, nb)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _block_links(rows: pa.Table, percent: int) -> pa.Table:
    """Links that join components, from the groups' blocks of one task."""
    order = np.lexsort((rows.column("node").to_numpy(), rows.column("team").to_numpy()))
    rows = rows.take(pa.array(order))
    team, node, root, left, right = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("team", "node", "root", "left", "right"))
    sets = [_decode(x) for x in rows.column("s").to_pylist()]
    size = np.array([len(x) for x in sets])
    out = []
    for own in np.split(np.arange(len(team)), np.flatnonzero(np.diff(team)) + 1):
        a, b = own[left[own]], own[right[own]]
        if not len(a) or not len(b):
            continue
        both = _overlaps([sets[i] for i in a], [sets[i] for i in b])
        linked = (100 * both >= percent * (size[a][:, None] + size[b][None, :] - both)) & (root[a][:, None] != root[b][None, :])
        x, y = np.nonzero(linked)
        pairs = np.unique(np.sort(np.stack((root[a][x], root[b][y]), 1), 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        parent: dict[int, int] = {}

        def top(k: int, parent: dict[int, int] = parent) -> int:
            while (p := parent.get(k, k)) != k:
                k = p
            return k

        for p, q in pairs.tolist():
            if (u := top(p)) != (v := top(q)):
                parent[max(u, v)] = min(u, v)
                out.append({"a": p, "b": q})
    return pa.Table.from_pylist(out, _LINKS)


def _chance_pairs(met: DataFrame, labels: DataFrame, few: int) -> DataFrame:
    """(a, b), a < b: documents of different components that share a key of at most ``few`` documents.

    Pairs with the key's pivot are left out: they have been compared.
    """
    small = met.filter(F.col("n") <= few)
    held = small.select("key", "node", "pivot").union(small.select("key", F.col("pivot").alias("node"), "pivot").distinct()).join(labels, "node")
    mixed = held.groupBy("key").agg(F.collect_list(F.struct("node", "root")).alias("own"), F.min("pivot").alias("pivot"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
    rest = F.filter("own", lambda x: x.node != F.col("pivot"))
    mates = lambda x: F.transform(F.filter(F.col("rest"), lambda y: (y.node > x.node) & (y.root != x.root)), lambda y: F.struct(x.node.alias("a"), y.node.alias("b")))
    pairs = mixed.withColumn("rest", rest).select(F.explode(F.flatten(F.transform("rest", mates))).alias("p"))
    return pairs.select("p.*").distinct()


def _hub_groups(met: DataFrame, labels: DataFrame, few: int) -> DataFrame:
    """(root, group): components that share a key of more than ``few`` documents with its largest one, and that one."""
    large = met.filter(F.col("n") > few)
    held = large.select("key", "node").union(large.select("key", F.col("pivot").alias("node")).distinct())
    sizes = held.join(labels, "node").groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    hubs = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key", F.col("m.root").alias("group"))
    near = sizes.join(hubs, "key").select("root", "group").distinct()
    return materialize(near)


def _compare_blocks(groups: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between the roots of a group's components (see ``_hub_groups``)."""
    inside = materialize(labels.join(groups, "root"))
    parts = inside.groupBy("group").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("root") == F.col("group")).alias("n_hub"))
    shape = parts.select("group", "total", F.col("group").alias("hub"), "n_hub")
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    shaped = inside.join(shape, "group").withColumn("nh", blocks(F.col("n_hub"))).withColumn("nr", blocks(F.col("total") - F.col("n_hub")))
    small = F.col("total") <= block // 2
    row = F.xxhash64("node")
    spot = F.when(F.col("root") == F.col("hub"), F.pmod(row, "nh")).otherwise(F.pmod(row, "nr")).cast("int")

    def tile(kind: str, i, j, left: bool, right: bool):
        return F.struct(F.xxhash64("group", F.lit(kind), i, j).alias("team"), F.lit(left).alias("left"), F.lit(right).alias("right"))

    every = lambda n, body: F.transform(F.sequence(F.lit(0), n - 1), body)
    hub_tiles = every(F.col("nr"), lambda j: tile("h", F.col("spot"), j, True, False))
    own_tiles = every(F.col("nh"), lambda i: tile("h", i, F.col("spot"), False, True))
    rest_tiles = every(F.col("nr"), lambda j: F.struct(F.xxhash64("group", F.lit("r"), F.least("spot", j), F.greatest("spot", j)).alias("team"), (F.col("spot") <= j).alias("left"), (F.col("spot") >= j).alias("right")))
    whole = F.array(F.struct(F.xxhash64("group").alias("team"), F.lit(True).alias("left"), F.lit(True).alias("right")))
    tiles = F.when(small, whole).when(F.col("root") == F.col("hub"), hub_tiles).otherwise(F.concat(own_tiles, rest_tiles))
    count = inside.count()
    if not count:
        return groups.select(F.col("root").alias("a"), F.col("group").alias("b"))
    placed = shaped.withColumn("spot", spot).select("node", "root", small.alias("small"), F.explode(tiles).alias("t")).select("node", "root", "small", "t.*")
    task = F.when(F.col("small"), F.pmod("team", F.lit(max(1, count // block)))).otherwise(F.col("team"))
    tiled = placed.withColumn("task", task).join(sets, "node")
    return materialize(tiled.select("task", "team", "node", "root", "left", "right", "s").groupBy("task").applyInArrow(lambda t: _block_links(t, percent), "a long, b long"))


def _meetings(classes: DataFrame, tables: int) -> DataFrame:
    """key, node, pivot (the key's smallest node) and n (its number of nodes), for the other nodes of keys with several."""
    # a class becomes tables ** 2 keys: enough tasks for a hash table of a task's keys to fit
    parts = max(1, min(20_000, -(-classes.count() * tables**2 // 1_000_000)))
    pairs_of_tables = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(i * tables + j, x, y))))
    keyed = classes.repartition(parts, "node").select("node", F.explode(pairs_of_tables).alias("key"))
    pivots = materialize(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return materialize(keyed.join(pivots, "key").filter("pivot != node"))


def _components(docs: DataFrame, classes: DataFrame, width: int, percent: int, tables: int, block: int, few: int) -> DataFrame:
    """(node, root) of the classes that meet another."""
    met = _meetings(classes, tables)
    nodes = materialize(met.select("node").union(met.select("pivot")).distinct())
    labels = nodes.select("node", F.col("node").alias("root"))
    if nodes.isEmpty():
        return labels
    sets = _sets(docs, nodes, width)
    stars = materialize(met.groupBy("pivot", "node").agg(F.count(F.lit(1)).alias("n")))
    tested = _confirm(stars.groupBy(F.col("node").alias("b")).agg(F.min("pivot").alias("a")).select("a", "b"), sets, percent)
    labels = connect(labels, tested.filter("linked"))

    def rooted(frame: DataFrame, by: str, name: str) -> DataFrame:
        return frame.join(labels.select(F.col("node").alias(by), F.col("root").alias(name)), by)

    left = materialize(rooted(rooted(stars, "node", "rb"), "pivot", "ra").filter("ra != rb").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    left = materialize(left.join(tested, ["a", "b"], "left_anti"))
    labels = connect(labels, _confirm(left, sets, percent).filter("linked"))
    chance = materialize(_chance_pairs(met, labels, few).join(stars.select(F.col("pivot").alias("a"), F.col("node").alias("b")), ["a", "b"], "left_anti"))
    labels = connect(labels, _confirm(chance, sets, percent).filter("linked"))
    return connect(labels, _compare_blocks(_hub_groups(met, labels, few), labels, sets, percent, block))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, tables: int = 14, depth: int = 3, block: int = 800, few: int = 32) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    sketched = materialize(sketch(docs, width, tables, depth))
    known = sketched.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = materialize(known.groupBy("digest").agg(F.min(F.struct("doc_id", "a", "b")).alias("m")).select("digest", F.col("m.doc_id").alias("node"), "m.a", "m.b"))
    labels = settle(lambda: _components(docs, classes, width, percent, tables, block, few))
    roots = classes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    joined = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(roots, "digest", "left")
    component = F.coalesce("root", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` without those whose group has a document with a smaller identifier.

    Of several rows with one identifier one stays (the one whose text has the smallest hash); rows
    without an identifier all stay.
    """
    judged = near_duplicates(docs, width, percent).filter(F.col("doc_id").isNotNull())
    by_id = materialize(judged.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("k")).filter("NOT kept OR k > 1"))
    single = docs.join(by_id.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    several = docs.join(by_id.filter("kept").select("doc_id"), "doc_id", "left_semi")
    one = several.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.col("text"))).alias("_row"))
    return single.unionByName(one.select(*(F.col("_row")[c].alias(c) for c in docs.columns)))


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP6_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({SQL_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
c AS (SELECT s, len(s) AS n, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY s),
g AS (SELECT rep, n, unnest(s) AS x FROM c),
l AS (SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS rep, a AS other FROM e UNION SELECT r.rep, e.b FROM r JOIN e ON r.other = e.a),
t AS (SELECT rep, min(other) AS root FROM r GROUP BY rep)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(t.root, c.rep, s.doc_id) AS component_id, s.doc_id = coalesce(t.root, c.rep, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.s = s.s AND len(s.s) > 0 LEFT JOIN t ON t.rep = c.rep
"""
