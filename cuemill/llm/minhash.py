"""MinHash near-duplicates with fast similarity sketching.

Sketch: in round i every shingle of a set is hashed into one of t bins; the first rounds throw at random and the last t rounds put all
shingles into bin i - t, so every coordinate fills, after about (t log t) / |set| rounds, with concentration as strong as independent
MinHashes. Then: banding of the sketch, exact verification on full shingle sets, and connected components.

Skew: exact copies collapse to one class before banding. A bucket is first resolved by stars (a few centres against its members),
which is linear in its size; what stays apart is then compared within bounded groups of two blocks of a bucket, inside a task, so
that only pairs that join components leave it. Members of one component are not compared again.

Defined results: a null or empty text has no shingles and is linked with nothing; rows with a null id get a null component and are
kept; rows that share an id are one document, whose texts each link it; repeated rows repeat in the result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.llm.common import bounded_batches, cut_lineage, mix64, read_table, released, slices, text_bytes, useful_partitions, word_hashes

#: Bands and rows of a band: a pair at 0.8 is missed with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
#: Rounds of stars, by the number of centres of a bucket, before what stays apart is compared pairwise.
STARS = (3,)
#: Members of a block of a bucket; two blocks make a group.
BLOCK = 512
_STEPS = np.random.default_rng(9).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of k-word shingles of each text, one after the other, and n + 1 offsets."""
    data, offsets = text_bytes(column)
    words, _, _, at = word_hashes(data, offsets)
    counts = np.diff(at)
    last = np.maximum(counts - k, 0)  # index of a row's last shingle, if it has words
    n = np.where(counts > 0, last + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    start = np.repeat(at[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    value = np.zeros(len(start), np.uint64)
    left = np.minimum(counts[rows], k)
    for j in range(k):
        ok = j < left
        value[ok] += mix64(words[start[ok] + j] + _STEPS[j]) * _STEPS[j]
    value = mix64(value + left.astype(np.uint64))
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    value, rows = value[new], rows[new]
    return value, np.searchsorted(rows, np.arange(len(n) + 1))


def fast_sketch(values: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """A row of t coordinates for each set; rows of empty sets stay at the largest value."""
    n = len(offsets) - 1
    top = np.uint64(2**64 - 1)
    sketch = np.full(n * t, top)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    live, x = rows, values
    for i in range(2 * t):
        if not len(x):
            break
        h = mix64(x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        place = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else i - t
        np.minimum.at(sketch, live * t + place, np.uint64(i << 40) | (h & np.uint64(2**40 - 1)))
        ids = live[np.flatnonzero(np.diff(live, prepend=-1))]
        done = np.ones(n, bool)
        done[ids] = (sketch.reshape(n, t)[ids] != top).all(1)
        if done[ids].any():
            keep = ~done[live]
            live, x = live[keep], x[keep]
    return sketch.reshape(n, t)


def sketch_rows(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, the 128-bit class of the set and its band keys (null without shingles)."""
    schema = "doc_id long, n_shingles long, cls binary, bands array<long>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, offsets = shingle_sets(part.column("text"), k)
            n = np.diff(offsets)
            sketch = fast_sketch(values, offsets, BANDS * ROWS).reshape(len(n), BANDS, ROWS)
            keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(n), BANDS))
            for j in range(ROWS):
                keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + sketch[:, :, j])
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(values))))
            other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(values ^ np.uint64(0xABCDEF0123456789)))))
            cls = np.stack([total[offsets[1:]] - total[offsets[:-1]], other[offsets[1:]] - other[offsets[:-1]] + n.astype(np.uint64)], 1)
            some = n > 0
            names = pa.array([c.tobytes() if s else None for c, s in zip(cls, some)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()), mask=pa.array(~some))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), names, lists], names=["doc_id", "n_shingles", "cls", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), schema)


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, offsets = shingle_sets(part.column("text"), k)
            sets = [values[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.mapInArrow(released(run), "node long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""
    full = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").select("u", "v", "su", "sv")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("su"), batch.column("sv")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                if 100 * len(a) < percent * len(b) or not len(a):
                    good.append(False)
                    continue
                found = np.searchsorted(b, a)
                inter = int((b[np.minimum(found, len(b) - 1)] == a).sum())
                good.append(100 * inter >= percent * (len(a) + len(b) - inter))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return full.mapInArrow(released(run), "u long, v long")


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v")


def two_steps(links: DataFrame) -> DataFrame:
    """node, component: the smallest node within two links. Equal labels mean connected nodes; the converse needs connected()."""
    edges = both_ways(links)
    once = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("near"))
    again = edges.join(once.select(F.col("u").alias("v"), "near"), "v").groupBy("u").agg(F.min("near").alias("component"))
    return again.withColumnRenamed("u", "node")


def connected(links: DataFrame, most: int | None = None) -> DataFrame:
    """node, component (its smallest node), by minimum labels with pointer jumping; links (u, v) in either order."""
    edges = cut_lineage(both_ways(links).distinct(), most)
    label = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("component")).withColumnRenamed("u", "node")
    while True:
        near = edges.join(label.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("near"))
        step = label.join(near, label.node == near.u).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = cut_lineage(step.join(jump, "component").select("node", "old", F.least("component", "further").alias("component")), most)
        label = moved.select("node", "component")
        if not moved.filter("old <> component").head(1):
            return label


def _star_pairs(apart: DataFrame, centres: int, near) -> DataFrame:
    """Each bucket's heaviest node of every hash class, against the bucket's members in other components."""
    kind = F.pmod(F.xxhash64("node", F.lit(centres)), F.lit(centres))
    heavy = apart.groupBy("band").agg(*[F.max(F.when(kind == i, F.struct("w", "node", "n", "comp"))).alias(f"c{i}") for i in range(centres)])
    centre = heavy.select("band", F.explode(F.array(*[f"c{i}" for i in range(centres)])).alias("c")).filter("c is not null").select("band", F.col("c.node").alias("cu"), F.col("c.n").alias("cn"), F.col("c.comp").alias("cc"))
    met = apart.join(centre, "band").filter("comp <> cc").filter(near)
    return met.select(F.least("node", "cu").alias("u"), F.greatest("node", "cu").alias("v")).distinct()


def joining_pairs(node: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int, full: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that join the components of a group of at most 2 * BLOCK documents: all members outside the commonest component against all.

    sets: sorted distinct 32-bit hashes; full: sizes of the sets before hashes were cut. Shingles that two sets share can fall together,
    so an intersection can be as much larger as a set has lost; others can meet by chance, so it can be smaller. A pair that reaches the
    similarity by more than chance is enough to join two components; of those that still stand apart, all pairs that may reach it go
    out, to be confirmed on full sets, and none stands for another.
    """
    names, comp = np.unique(comp, return_inverse=True)
    if len(names) < 2:
        return []
    asked = np.flatnonzero(comp != np.bincount(comp).argmax())
    size = np.array([len(x) for x in sets])
    full = size if full is None else full
    lost = full - size
    value, at = np.unique(np.concatenate([sets[i] for i in asked]), return_inverse=True)
    inter = np.zeros((len(asked), len(sets)))
    step = max(1, (1 << 22) // max(1, len(asked) + len(sets)))  # shingles at a time, for bounded memory
    row = np.repeat(np.arange(len(asked)), size[asked])
    everyone = np.concatenate(sets)
    place = np.minimum(np.searchsorted(value, everyone), len(value) - 1)
    owner = np.repeat(np.arange(len(sets)), size)
    known = value[place] == everyone
    place, owner = place[known], owner[known]
    for lo in range(0, len(value), step):
        left, right = np.zeros((len(asked), min(step, len(value) - lo)), np.float32), np.zeros((len(sets), min(step, len(value) - lo)), np.float32)
        m = (at >= lo) & (at < lo + step)
        left[row[m], at[m] - lo] = 1
        m = (place >= lo) & (place < lo + step)
        right[owner[m], place[m] - lo] = 1
        inter += left @ right.T
    both = full[asked][:, None] + full[None]
    reached = lambda shared: 100 * shared >= percent * (both - shared)
    good = reached(inter - 4 - full[asked][:, None] * (full[None] / 2**30))
    maybe = reached(inter + np.minimum(lost[asked][:, None], lost[None])) & ~good
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(good)):
        x, y = find(comp[asked[i]]), find(comp[j])
        if x != y:
            parent[x] = y
            out.append((int(min(node[asked[i]], node[j])), int(max(node[asked[i]], node[j]))))
    for i, j in zip(*np.nonzero(maybe)):
        if find(comp[asked[i]]) != find(comp[j]):
            out.append((int(min(node[asked[i]], node[j])), int(max(node[asked[i]], node[j]))))
    return out


def _pairs_in_buckets(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that join components within buckets. A bucket is dealt in pairs of blocks of about BLOCK members, each a bounded group."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [np.unique((np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(32)).astype(np.uint32)).tobytes() for x in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(small, pa.binary())], names=["node", "small"])

    blocks = apart.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = apart.select("band", "node", "comp", "n").join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    full = dealt.join(sets.dropDuplicates(["node", "shingles"]).mapInArrow(fold, "node long, small binary"), "node").select("band", "i", "j", "node", "comp", "n", "small")
    width = int(apart.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = full.repartition(width, "band", "i", "j").sortWithinPartitions("band", "i", "j")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def settle(table: pa.Table) -> pa.RecordBatch:
            band, i, j, node, comp, n = (table.column(c).to_numpy() for c in ("band", "i", "j", "node", "comp", "n"))
            sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("small")]
            cuts = np.flatnonzero(np.concatenate(([True], (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True])))
            out = [p for a, b in zip(cuts, cuts[1:]) if b - a > 1 for p in joining_pairs(node[a:b], comp[a:b], sets[a:b], percent, n[a:b])]
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [held.column(c).to_numpy() for c in ("band", "i", "j")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = held.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:  # sorted: what stands before the last group is complete
                yield settle(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield settle(held)

    return grouped.mapInArrow(released(run), "u long, v long").filter("u <> v").distinct()


def _apart(active: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """The buckets that hold more than one component, with the members' components as far as two links show them."""
    marked = active.join(two_steps(links), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    split = marked.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band")
    return cut_lineage(marked.join(split, "band"), most)


def components(docs: DataFrame, k: int = 5, percent: int = 80, stars: tuple[int, ...] = STARS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    most = useful_partitions(docs)
    rows = cut_lineage(sketch_rows(docs, k), most)
    known = rows.filter(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())
    reps = known.groupBy("cls").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r")).select("cls", "r.*")
    banded = reps.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
    active = cut_lineage(banded.join(shared, "band").select("band", "node", "n", "c"), most)
    #: how often a node meets others: what a family was copied from meets most, so it makes the best centre
    active = active.join(active.groupBy("node").agg(F.sum("c").alias("w")), "node").select("band", "node", "n", "w")
    member = known.select("doc_id", "cls").distinct().join(reps.select("cls", F.col("doc_id").alias("rep")), "cls").select("doc_id", "rep")
    #: ids with several texts belong to several classes
    links = (member.groupBy("doc_id").agg(F.min("rep").alias("u"), F.collect_set("rep").alias("vs")).filter(F.size("vs") > 1).select("u", F.explode("vs").alias("v")).filter("u <> v"))
    wanted = active.select(F.col("node").alias("doc_id")).distinct()
    sets = cut_lineage(set_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi"), k), most)
    near = F.expr(f"100 * least(n, cn) >= {percent} * greatest(n, cn)")
    apart = active.withColumn("comp", F.col("node"))
    for centres in stars:
        links = cut_lineage(links.unionByName(verified(_star_pairs(apart, centres, near), sets, percent)), most)
        apart = _apart(active, links, most)
    rest = _pairs_in_buckets(apart, sets, percent)
    label = connected(links.unionByName(verified(rest, sets, percent)), most)
    final = member.join(label.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""
