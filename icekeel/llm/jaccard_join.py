"""N-gram Jaccard join: parity sketches, a pigeonhole join within size bands, and verification.

A document's set of shingle hashes is cut by hash range into P parts. Each part is a parity
sketch: a token toggles its own bit of a wide bit vector, which is held by the XOR of the codes
of the bits that are set. Two sets whose symmetric difference is at most D differ in at most D
bits, so with P = D + 1 + s parts at least s + 1 parts are equal; if one of the two sets leaves
at most s parts empty, an equal part that isn't empty is certain. The rare sets with more empty
parts also emit their empty parts, each paired with every part of a second, independent sketch.
P depends on the size band; a set also joins the bands that its possible partners are in.

The sets that share a part with its smallest holder, the pivot, are a cluster. Within a cluster short parity
sketches of whole sets are compared: their Hamming distance is at most the symmetric difference, so
only sets with a partner within D bits go on, and are verified on their whole elements until what
belongs together is linked. A cluster too large for that is verified against its pivot first, and then its
members are compared by their differences from the pivot, in a prefix join that meets all remaining
pairs which may reach the threshold, but not all pairs of the cluster. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icekeel.llm._common import U64, batched, drop, hashed_texts, materialize, mix64, release, shingle_hashes, sliced, small_side, trim, word_hashes
from icekeel.llm.components import connected_components

#: Ratio of a size band's ends, and low bits of a key that name the band.
BAND, BAND_BITS = 1.4, 6
#: Bits of a whole set's sketch for each element by which sets of its band may differ.
WIDTH = 6
#: Keys of a run in which large buckets are looked for, and how often a key stands in it then.
RUN_KEYS, HOT = 1 << 21, 512
#: Words of sketches that comparing one cluster's members may touch; a larger cluster takes the other way.
WORK = 1 << 25


class Bands:
    """Size bands for a threshold of pct percent."""

    def __init__(self, pct: int):
        if not 50 <= pct <= 100:
            raise ValueError("the threshold must be from 50 to 100 percent")
        self.pct, self.starts, self.memo, self.widths = pct, [1], {}, {}

    def band(self, n: int) -> int:
        while self.starts[-1] <= n:
            self._extend()
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def _extend(self) -> None:
        self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * BAND)))

    def of(self, n: int) -> range:
        """The bands in which a set of n elements meets partners at least as large as itself, and its own."""
        return range(self.band(n), self.band(n * 100 // self.pct) + 1)

    def most(self, band: int) -> int:
        """The largest symmetric difference of two linked sets that meet in a band."""
        while len(self.starts) < band + 2:
            self._extend()
        return 2 * (self.starts[band + 1] - 1) * (100 - self.pct) // (100 + self.pct)

    def parts(self, band: int) -> tuple[int, int]:
        """(P, s) of a band; P = 0: sets there have no partner but equal sets."""
        if band not in self.memo:
            most = self.most(band)
            low = self.starts[band] * self.pct / 100
            s = 0
            while most and (z := (most + 1 + s) * math.exp(-low / (most + 1 + s))) + 3 * math.sqrt(z) > s and s < most:
                s += 1
            self.memo[band] = (most + 1 + s if most else 0, s)
        return self.memo[band]

    def words(self, band: int) -> int:
        """64-bit words of a whole set's sketch in a band: a power of two."""
        if band not in self.widths:
            self.widths[band] = 1 << max(0, (WIDTH * self.most(band) - 1).bit_length() - 6)
        return self.widths[band]

    def slack(self, x, y):
        """The largest symmetric difference of linked sets of x and y elements."""
        return (x + y) * (100 - self.pct) // (100 + self.pct)


def part_codes(hashes: np.ndarray, parts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct hashes: the XOR code of every part, and which parts have elements."""
    part = ((hashes >> U64(32)) * U64(parts)) >> U64(32)
    starts = np.flatnonzero(np.diff(part, prepend=U64(parts)))
    codes, full = np.zeros(parts, U64), np.zeros(parts, bool)
    at = part[starts].astype(np.int64)
    codes[at], full[at] = np.bitwise_xor.reduceat(mix64(hashes, seed), starts), True
    return codes, full


def sketch_keys(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """Bucket keys of a set of sorted distinct hashes; two sets that reach the threshold share one, or are equal. The low bits name the band."""
    out = []
    for band in bands.of(len(hashes)) if len(hashes) else ():
        parts, slack = bands.parts(band)
        if not parts:
            continue
        codes, full = part_codes(hashes, parts, 11)
        salt = mix64(np.arange(parts, dtype=U64), 1000 + band)
        keys = [mix64(codes ^ salt, 12)[full]]
        if (empty := np.flatnonzero(~full)).size > slack:
            second, _ = part_codes(np.sort(mix64(hashes, 13)), parts, 14)
            keys.append(mix64(mix64(second ^ salt, 15)[None, :] ^ salt[empty][:, None], 16).ravel())
        out += [(x >> U64(BAND_BITS) << U64(BAND_BITS)) | U64(band) for x in keys]
    return np.concatenate(out) if out else np.zeros(0, U64)


def parity_sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """The parity of the elements at each bit, as 64-bit words."""
    bits = words * 64
    at = (mix64(hashes, 17) >> U64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view("<u8")


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text."""
    return np.unique(shingle_hashes(word_hashes((text or "").encode().lower())[0], k))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) for each row, hashing the words of many rows at once."""
    for i, hashes in enumerate(hashed_texts([(t or "").encode().lower() for t in batch.column("text").to_pylist()])):
        yield i, np.unique(shingle_hashes(hashes, k))


def _hot_keys(run_keys: int, hot: int):
    """Lists of keys -> the keys that stand hot times or more in a run of some run_keys keys of one task."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found[counts >= hot])], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            values = batch.column(0).flatten().to_numpy()
            for at in range(0, len(values), run_keys):
                held.append(values[at : at + run_keys])
                n += len(held[-1])
                if n >= run_keys:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)
        trim()

    return run


def _print_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits by which equal sets are known."""
    return (int(np.add.reduce(mix64(s, 21)).view(np.int64)), int(np.add.reduce(mix64(s, 22)).view(np.int64))) if len(s) else (0, 0)


def _features(k: int, pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(pct)
        for batch in sliced(batches):
            n, prints, keys, sketches = [], [], [], []
            for _, s in _sets(batch, k):
                n.append(len(s))
                prints.append(_print_of(s))
                keys.append(sketch_keys(s, bands).view(np.int64))
                own = [parity_sketch(s, bands.words(b)) for b in (bands.of(len(s)) if len(s) else ()) if bands.parts(b)[0]]
                sketches.append(np.concatenate(own).tobytes() if own else b"")
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            f1, f2 = (pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), f1, f2, lists, pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "keys", "sketches"])

    return run


def _set_rows(k: int):
    """docs -> (doc_id, f1, f2, elements); rows of one task that repeat another come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in sliced(batches):
            ids, rows = batch.column("doc_id").to_pylist(), []
            for i, s in _sets(batch, k):
                row = (ids[i], *_print_of(s))
                if row not in seen:
                    seen.add(row)
                    rows.append((*row, s.tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True)], ["doc_id", "f1", "f2", "elements"])

    return run


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0


def _linked(x: np.ndarray, y: np.ndarray, pct: int) -> bool:
    same = _same(x, y)
    return 100 * same >= pct * (len(x) + len(y) - same)


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (band, pivot), which come sorted so."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        pivot, band = t.column("pivot").to_numpy(), t.column("band").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(pivot) != 0) | (np.diff(band) != 0)) + 1).tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield t.slice(a, b - a)
        held = t.slice(edges[-1])
    if held is not None:
        yield held


def _near(i: int, others: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, bands: Bands) -> np.ndarray:
    """Which of others, all at least as large as i, may reach the threshold with it by their sketches."""
    others = others[sizes[others] * bands.pct <= sizes[i] * 100]
    far = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1, dtype=np.int64)
    return others[far <= bands.slack(sizes[others], sizes[i])]


def _meeting(pct: int):
    """Clusters (band, pivot, node, n_shingles, sketches) -> the rows (band, pivot, node) that have a partner by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(pct)
        for t in _clusters(batches):
            t = t.sort_by("n_shingles")
            band, sizes = t.column("band")[0].as_py(), t.column("n_shingles").to_numpy()
            words, own = bands.words(band), []
            for n, s in zip(sizes.tolist(), t.column("sketches").to_pylist(), strict=True):
                at = sum(bands.words(b) for b in range(bands.band(n), band) if bands.parts(b)[0])
                own.append(np.frombuffer(s, "<u8", words, 8 * at))
            sketches, met = np.stack(own), np.zeros(len(sizes), bool)
            for i in range(len(sizes) - 1):
                others = np.arange(i + 1, len(sizes))
                near = _near(i, others[~met[i + 1 :]] if met[i] else others, sizes, sketches, bands)
                if len(near):
                    met[i] = met[near] = True
            if met.any():
                yield from t.filter(pa.array(met)).select(["band", "pivot", "node"]).combine_chunks().to_batches()

    return run


def _linking(pct: int):
    """Clusters (band, pivot, node, elements) -> links (a, b) that join what is connected in each; a set that is there already isn't compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(pct)
        for t in _clusters(batches):
            by_node = dict(zip(t.column("node").to_pylist(), t.column("elements").to_pylist(), strict=True))
            members = sorted(((np.frombuffer(s, U64), node) for node, s in by_node.items()), key=lambda m: (len(m[0]), m[1]))
            sizes = np.array([len(s) for s, _ in members])
            sketches = np.stack([parity_sketch(s, bands.words(t.column("band")[0].as_py())) for s, _ in members])
            group, links = np.arange(len(members)), []
            for i in range(len(members) - 1):
                others = np.arange(i + 1, len(members))
                for j in _near(i, others[group[i + 1 :] != group[i]], sizes, sketches, bands):
                    if group[i] != group[j] and _linked(members[i][0], members[j][0], pct):
                        group[group == group[j]] = group[i]
                        links.append((members[i][1], members[j][1]))
            if links:
                a, b = zip(*((min(x), max(x)) for x in links), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _verified(pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(np.frombuffer(x, U64), np.frombuffer(y, U64), pct) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    x, y = sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(_verified(pct), "a long, b long")


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, sizes = [], []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            tokens.append(np.setxor1d(x, y, assume_unique=True).view(np.int64))
            sizes.append(len(y))
        columns = [batch.column("pivot"), batch.column("node"), batch.column("component"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["pivot", "node", "component", "size", "tokens"])


def _by_differences(clusters: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) of different components in one pivot's cluster that may reach the threshold.

    The symmetric difference of two members is that of their differences from the pivot. If two
    differences have x and y elements and the sets may differ in D, they share (x + y - D) / 2 elements
    at least, and so one among the first (x - y + D) / 2 + 1 and (y - x + D) / 2 + 1 in any common
    order. Here rare elements come first: those that one member alone has are never joined. Members
    that need share nothing are both linked to the pivot, hence in one component.
    """
    x, y = sets.select(F.col("node").alias("pivot"), F.col("elements").alias("x")), sets.select("node", F.col("elements").alias("y"))
    diffs = clusters.join(x, "pivot").join(y, "node").mapInArrow(_differences, "pivot long, node long, component long, size long, tokens array<long>")
    diffs = materialize(diffs.filter(F.size("tokens") > 0).withColumn("far", F.size("tokens")))
    each = diffs.select("pivot", "node", F.explode("tokens").alias("token"))
    common = each.groupBy("pivot", "token").agg(F.count("*").alias("n")).filter("n > 1")
    # Elements of one member alone fill the first places, then the common ones by rarity.
    nth = each.join(common, ["pivot", "token"]).groupBy("pivot", "node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("shared"))
    ranked = nth.join(diffs.drop("tokens"), ["pivot", "node"]).select("pivot", "node", "component", "size", "far", (F.col("far") - F.size("shared")).alias("alone"), F.posexplode("shared").alias("k", "s"))
    most = F.expr(f"(size + size * 100 div {pct}) * {100 - pct} div {100 + pct}")
    ranked = materialize(ranked.withColumn("nth", F.col("alone") + F.col("k")).filter(F.col("nth") <= most).select("pivot", F.col("s.token").alias("token"), "node", "component", "size", "far", "nth"))
    drop(diffs)
    a, b = (ranked.select("pivot", "token", *(F.col(c).alias(f"{c}_{t}") for c in ("node", "component", "size", "far", "nth"))) for t in "ab")
    slack = F.expr(f"(size_a + size_b) * {100 - pct} div {100 + pct}")
    near = (2 * F.col("nth_a") <= F.col("far_a") - F.col("far_b") + slack) & (2 * F.col("nth_b") <= F.col("far_b") - F.col("far_a") + slack)
    met = (a.pivot == b.pivot) & (a.token == b.token) & (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & near
    out = materialize(a.join(b, met).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    drop(ranked)
    return out


def _with_sets(rows: DataFrame, docs: DataFrame, narrow: DataFrame, k: int) -> DataFrame:
    """rows (node, ...) with elements, the node's whole set; a node of repeated rows may come more than once."""
    named = materialize(rows.join(narrow.select(F.col("rid").alias("node"), "doc_id", "f1", "f2"), "node"))
    ids = materialize(named.select("doc_id").distinct())
    sets = docs.join(small_side(ids), "doc_id", "left_semi").mapInArrow(_set_rows(k), "doc_id long, f1 long, f2 long, elements binary")
    return sets.join(small_side(named), ["doc_id", "f1", "f2"]).select(*rows.columns, "elements")


def _in_large(clusters: DataFrame, links: DataFrame, docs: DataFrame, narrow: DataFrame, pct: int, k: int) -> DataFrame:
    """Links (a, b) in clusters (band, pivot, node) of any size, given the links of the smaller ones."""
    sets = materialize(_with_sets(clusters.select("node").distinct(), docs, narrow, k).dropDuplicates(["node"]))
    star = clusters.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    found = materialize(links.union(_verify(star, sets, pct)))
    labels = connected_components(found)
    placed = clusters.filter("node <> pivot").select("pivot", "node").distinct().join(labels.withColumnRenamed("id", "node"), "node", "left").select("pivot", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("pivot").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("pivot")
    mixed = materialize(placed.join(mixed, "pivot"))
    if mixed.take(1):
        pairs = _by_differences(mixed, sets, pct)
        found = materialize(found.union(_verify(pairs, sets, pct)))
        drop(pairs)
    drop(sets)
    return found


def jaccard_components(docs: DataFrame, k: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are what ASCII white space separates, after lower-casing A-Z; a document's set holds its
    distinct k-word shingles, or its whole sequence if shorter. Documents link when 100 * |A & B| >=
    pct * |A | B|; component_id is the smallest id reachable. Links are looked for only until
    components are whole, so their number isn't known.
    Null or empty texts have n_shingles 0 and are alone. Rows with a null id come back with a null
    component_id and link nothing. Rows that repeat an id come back as often; if their texts differ the id links all of them.
    Other columns of docs are ignored; an empty table gives no rows.
    """
    docs = batched(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wide = docs.mapInArrow(_features(k, pct), "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, sketches binary")
    wide = materialize(wide.withColumn("rid", F.monotonically_increasing_id()))
    release(docs.sparkSession)

    # Equal sets are one node, named by the smallest of their rows.
    rows = wide.select("rid", "doc_id", "n_shingles", "f1", "f2")
    classes = materialize(rows.filter("doc_id is not null and n_shingles > 0").groupBy("f1", "f2").agg(F.min("rid").alias("node"), F.count("*").alias("n")).filter("n > 1"))
    member = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    narrow = materialize(rows.join(small_side(classes), ["f1", "f2"], "left").select("rid", "doc_id", "n_shingles", "f1", "f2", F.when(member, F.coalesce("node", "rid")).alias("node"), (F.col("n").isNotNull() & member).alias("many")))
    copies = materialize(narrow.filter("node <> rid").select("rid"))
    nodes = wide.filter(member).join(small_side(copies), "rid", "left_anti")

    # Clusters: the sets of every bucket of equal parts, by its smallest one. Buckets meet in one shuffle; those that
    # are so large that they show in a run of keys are told apart, and their smallest sets found by partial aggregation.
    keys = nodes.select(F.explode("keys").alias("key"), F.col("rid").alias("node"))
    hot = materialize(wide.select("keys").mapInArrow(_hot_keys(RUN_KEYS, HOT), "key long").distinct())
    band = F.col("key").bitwiseAND((1 << BAND_BITS) - 1).cast("int").alias("band")
    bucket = Window.partitionBy("key")
    rest = keys.join(small_side(hot), "key", "left_anti").select("key", "node", F.min("node").over(bucket).alias("pivot"), F.count("*").over(bucket).alias("n"))
    shared = rest.filter("n > 1").select(band, "pivot", "node")
    if hot.take(1):
        own = keys.join(small_side(hot), "key")
        least = materialize(own.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("key", "pivot"))
        shared = shared.union(own.join(small_side(least), "key").select(band, "pivot", "node"))
    clusters = materialize(shared.distinct())
    release(docs.sparkSession)

    words = Bands(pct)
    width = F.element_at(F.array(*(F.lit(words.words(b)) for b in range(1 << BAND_BITS))), F.col("band") + 1)
    sized = clusters.groupBy("band", "pivot").agg(F.count("*").alias("n"))
    beyond = materialize(sized.filter(F.col("n") * F.col("n") * width > WORK).select("band", "pivot"))
    small = clusters.join(small_side(beyond), ["band", "pivot"], "left_anti")

    known = nodes.select(F.col("rid").alias("node"), "n_shingles", "sketches")
    met = small.join(known, "node").repartition("band", "pivot").sortWithinPartitions("band", "pivot")
    met = materialize(met.mapInArrow(_meeting(pct), "band int, pivot long, node long"))
    drop(wide)
    release(docs.sparkSession)
    whole = _with_sets(met, docs, narrow, k).repartition("band", "pivot").sortWithinPartitions("band", "pivot")
    links = materialize(whole.mapInArrow(_linking(pct), "a long, b long").distinct())
    if beyond.take(1):
        links = _in_large(materialize(clusters.join(small_side(beyond), ["band", "pivot"])), links, docs, narrow, pct, k)
    for t in (hot, clusters, met):
        drop(t)

    # An id whose texts differ links them.
    placed = narrow.filter("node is not null").select("doc_id", "node", "many")
    repeated = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id", "a")
    own = placed.join(repeated, "doc_id").filter("a < node").select("a", F.col("node").alias("b"))
    labels = connected_components(links.union(own))
    joined = placed.join(small_side(labels.withColumnRenamed("id", "node")), "node", "left").filter("many or component is not null").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = materialize(joined.select("node", "component").distinct().join(least, "component").select("node", "component_id"))
    out = narrow.join(small_side(found), "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """docs without the documents whose component has a smaller id; their columns as they are.

    Rows with a null id or an empty text stay. Rows that repeat an id stay or go together.
    """
    gone = materialize(jaccard_components(docs, k, pct).filter("component_id <> doc_id").select("doc_id").distinct())
    release(docs.sparkSession)
    return docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)
