"""Near-duplicate classes by improved consistent weighted sampling (ICWS) of TF-IDF shingles.

1. Words (lower-cased, split at white space) form shingles of ``SHINGLE`` words; a shorter text
   is one shingle. A first pass over all texts adds every text's shingles to a count sketch of
   ``SKETCH_ROWS`` signed rows: the document frequency of a shingle is the median of its places,
   and 1 below the sketch's own noise, which grows with the root of the corpus alone.
2. A shingle weighs ``tf * idf``, with ``idf = 1 + STRENGTH * (1 - ln df / ln N)``, rounded on a
   log scale of ``1 / STEP``. STRENGTH is small on purpose: in a group of thousands of copies the
   shared shingles are frequent and the edits rare, and a full IDF would weigh the edits most.
3. A second pass takes ``HASHES`` samples per text. Texts of the same words are one from here on,
   whatever their ids. Bands of ``ROWS`` samples are the buckets.
4. In buckets of up to ``SMALL`` texts every pair with an estimate of at least ``ESTIMATE`` becomes
   a candidate. Larger ones are dealt out in chunks of about ``CHUNK`` texts: a maximum spanning
   tree and each text's ``BEST`` partners go first. One text of each of a chunk's clusters goes up a
   level, as long as that at least halves the bucket; chunks stay as small as they are.
5. Candidates are verified by the exact weighted Jaccard similarity, ``SIMILARITY`` or more. Links
   form classes by alternating stars.
6. What step 4 left out is then made good. In every larger bucket the texts outside its main class
   meet all of its texts, in blocks of ``BLOCK`` by ``BLOCK``, each a group of its own. A first round
   compares samples and names the texts that have a pair of different classes over ``ESTIMATE``;
   a second round holds the shingles of those and verifies each such pair in place. Only links
   leave a block, never pairs, and a pair is looked at in the first bucket that it shares alone.
   So the classes are those of all pairs of all buckets. The work of a bucket is the number of
   its texts times that of those outside its main class.

Only the sketch (3 MB) comes to the driver. Texts are not shuffled, but for the shingles of
candidates.

Defined results. Empty and null texts have no shingle; they are equal to each other and to
nothing else. A row without an id gets a null class and is kept. Rows that repeat an id and a
text are one document; rows that share an id but not the text are documents of their own, and an
id leaves ``drop_near`` only if none of its rows is kept. A class has the least id of its documents
as its id, and of equal ids the text of the least hash is kept. Extra columns do no harm. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import BROADCAST_IDS, Tables, checkpointed, ids_without_kept, small_batches, steps, table, without, worker_state

SHINGLE = 5
SIMILARITY = 0.8
#: Each row of the sketch has 1 << (SKETCH_BITS - 1) places: a hash's last bit is the sign.
SKETCH_BITS = 18
SKETCH_ROWS = 3
#: Standard deviations of the sketch's noise under which a count says nothing.
NOISE = 4
STRENGTH = 0.1
STEP = 16
ROWS = 3
BANDS = 14
HASHES = ROWS * BANDS
ESTIMATE = 0.55
SMALL = 24
BEST = 3
CHUNK = 256
#: Texts of a side of a block of a bucket's pairs, and bytes of their shingles.
BLOCK = 256
BLOCK_BYTES = 16 << 20
#: Links in a partition, at least, while classes form: few links make few and small files.
LINKS = 100_000
DRAW_BITS = 16
REMEMBER = 300_000
ODD = np.uint64(0x9E3779B97F4A7C15)
LOW48 = np.uint64((1 << 48) - 1)
STEP_BYTES = 1 << 20


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(texts: list[str], words: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(text, shingle, tf) ordered by text, the hash of each text's words, and their number."""
    if len(words) > REMEMBER:
        words.clear()
    parts = []
    for t in texts:
        split = t.lower().split()
        parts.append(np.fromiter(map(words.__getitem__, split), np.uint64, len(split)))
    sizes = np.array([len(p) for p in parts], np.int64)
    names = [xxhash.xxh3_128_digest(p.tobytes()) for p in parts]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    ends = np.cumsum(sizes)
    # Position i starts a shingle if 5 words follow in its text, or if it is the first of fewer.
    start = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    left = np.repeat(sizes, sizes) - start
    h = np.zeros(len(flat), np.uint64)
    for k in range(SHINGLE):
        shifted = np.zeros(len(flat), np.uint64)
        if k < len(flat):
            shifted[: len(flat) - k] = flat[k:]
        h = (h ^ np.where(left > k, shifted, np.uint64(0))) * ODD
        h ^= h >> np.uint64(29)
    h *= ODD
    begins = (left >= SHINGLE) | (start == 0)
    keys = (text[begins].astype(np.uint64) << np.uint64(48)) | (h[begins] >> np.uint64(16))
    keys.sort()
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    tf = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys >> np.uint64(48)).astype(np.int64), keys & LOW48, tf, names, sizes


ROW_ODD = np.random.default_rng(17).integers(0, 1 << 62, SKETCH_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def place(shingle: np.ndarray, row: int) -> np.ndarray:
    """Twice the shingle's place in a row of the sketch, plus one where its sign is negative."""
    h = shingle * ROW_ODD[row]
    h ^= h >> np.uint64(31)
    return ((h * ODD) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def log_idf(sketch: np.ndarray, n: int) -> tuple[np.ndarray, float, float]:
    """The sketch with signs (rows x 2 * places), its noise and ln n: all that ``levels`` asks for."""
    noise = 1.4826 * float(np.median(np.abs(sketch)))
    return np.stack((sketch, -sketch), axis=2).reshape(SKETCH_ROWS, -1).astype(np.float32), max(1.0, NOISE * noise), math.log(max(n, 2))


def levels(shingle: np.ndarray, tf: np.ndarray, idf) -> np.ndarray:
    """Weights as whole steps of their logarithm."""
    sketch, floor, log_n = idf
    a, b, c = (sketch[row][place(shingle, row)] for row in range(SKETCH_ROWS))
    df = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
    share = np.where(df >= floor, np.minimum(np.log(np.maximum(df, 1)) / np.float32(log_n), 1), np.float32(0))
    return np.rint(np.log(tf) * STEP + STEP * np.log1p(STRENGTH * (1 - share))).astype(np.int64)


class Sampler:
    """Draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) for each sample and each of 1 << DRAW_BITS places of a shingle's hash."""

    COMMON = 3  # levels of shingles that occur once, kept as tables

    def __init__(self, seed: int = 5):
        rng, shape = np.random.default_rng(seed), (HASHES, 1 << DRAW_BITS)
        self.r = rng.gamma(2, 1, shape).astype(np.float32) + np.float32(1e-6)
        self.c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.b = rng.random(shape, np.float32)
        self.odd = rng.integers(0, 1 << 62, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
        self.common = np.stack([self.rank(np.float32(level / STEP), self.r, self.c, self.b) for level in range(self.COMMON)], axis=1).reshape(HASHES, -1)

    @staticmethod
    def rank(log_w, r, c, b) -> np.ndarray:
        """ln a of ICWS as an unsigned number in the same order; it depends on the weight through t alone."""
        t = np.floor(log_w / r + b)
        a = (c - r * (t - b) - r).astype(np.float32).view(np.uint32)
        return np.where(a >> np.uint32(31), ~a, a | np.uint32(1 << 31))

    def signatures(self, text: np.ndarray, shingle: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
        """n rows of HASHES numbers; texts without shingles have zeros."""
        out = np.zeros((n, HASHES), np.uint32)
        if not len(text):
            return out
        starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        low = (shingle & np.uint64(0xFFFFFFFF)).astype(np.uint64)
        rare = np.flatnonzero(level >= self.COMMON)
        offset = np.minimum(level, self.COMMON - 1) << DRAW_BITS
        rare_w = (level[rare] / STEP).astype(np.float32)
        for k in range(HASHES):
            at = ((shingle * self.odd[k]) >> np.uint64(64 - DRAW_BITS)).astype(np.int64)
            rank = self.common[k][at + offset]
            if len(rare):
                own = at[rare]
                rank[rare] = self.rank(rare_w, self.r[k][own], self.c[k][own], self.b[k][own])
            best = np.minimum.reduceat((rank.astype(np.uint64) << np.uint64(32)) | low, starts)
            out[text[starts], k] = ((best * ODD) >> np.uint64(32)).astype(np.uint32)
        return out


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    h = np.zeros((len(signatures), BANDS), np.uint64)
    for r in range(ROWS):
        h = (h ^ signatures[:, r::ROWS][:, :BANDS].astype(np.uint64)) * ODD
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def sampler() -> Sampler:
    return worker_state("sampler", Sampler)


def frequencies(docs: DataFrame) -> np.ndarray:
    """The count sketch of the documents' shingles, over all documents; 3 MB on the driver."""
    per_row, width = 32, (1 << SKETCH_BITS) // 64
    blocks = per_row * SKETCH_ROWS

    def count(batches):
        words, held = WordHashes(), np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
        for batch in batches:
            for step in steps([batch], step_bytes=STEP_BYTES):
                _, shingle, _, _, _ = shingles(step.column(1).to_pylist(), words)
                for row in range(SKETCH_ROWS):
                    held[row] += np.bincount(place(shingle, row), minlength=1 << SKETCH_BITS)
        parts = (held[:, ::2] - held[:, 1::2]).reshape(blocks, width)
        some = [k for k in range(blocks) if parts[k].any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].astype(np.int32).tobytes() for k in some], pa.binary())], names=["block", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(raw, np.int32 if len(raw) == 4 * width else np.int64).astype(np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["block", "counts"])

    parts = docs.select("doc_id", "text").mapInArrow(count, "block int, counts binary")
    # Sums of about the square root of the partitions first, then of those: no task gathers them all.
    parts = parts.repartition(max(8, math.isqrt(docs.rdd.getNumPartitions()))).mapInArrow(add, "block int, counts binary")
    parts = parts.repartition(4, "block").mapInArrow(add, "block int, counts binary")
    out = np.zeros((blocks, width), np.int64)
    for row in parts.toLocalIterator():
        out[row["block"]] += np.frombuffer(row["counts"], np.int64)
    return out.reshape(SKETCH_ROWS, -1)


def sampled(docs: DataFrame, idf) -> DataFrame:
    """doc_id, name (hash of the words), n_words, bands and sig of every document."""

    def rows(batches):
        words, draw = WordHashes(), sampler()
        for batch in batches:
            for step in steps([batch], step_bytes=STEP_BYTES):
                text, shingle, tf, names, sizes = shingles(step.column(1).to_pylist(), words)
                sig = draw.signatures(text, shingle, levels(shingle, tf, idf.value), step.num_rows)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * step.num_rows + 1, BANDS), pa.int32()), pa.array(band_hashes(sig).reshape(-1)))
                yield pa.RecordBatch.from_arrays([step.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), bands, pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "name", "n_words", "bands", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, name binary, n_words long, bands array<long>, sig binary")


def spanning(ids: np.ndarray, sig: np.ndarray) -> tuple[set, np.ndarray]:
    """Candidate pairs of one bucket, and one text of each cluster that they form."""
    m, pairs = len(ids), set()
    if m <= SMALL:
        alike = (sig[:, None, :] == sig[None, :, :]).mean(axis=2) >= ESTIMATE
        group = np.arange(m)
        for i, j in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
            pairs.add((int(ids[i]), int(ids[j])))
            group[group == group[j]] = group[i]
        return pairs, ids[np.unique(group)]
    best, link, out, heads = np.full(m, -1.0), np.zeros(m, np.int64), np.zeros(m, bool), []
    for _ in range(m):
        k = int(np.argmax(np.where(out, -2.0, best)))
        if best[k] >= ESTIMATE:
            pairs.add((int(ids[link[k]]), int(ids[k])))
        else:
            heads.append(k)
        out[k] = True
        alike = (sig == sig[k]).mean(axis=1)
        closer = alike > best
        best[closer], link[closer] = alike[closer], k
        alike[k] = -1
        for j in np.argpartition(alike, -BEST)[-BEST:]:
            if alike[j] >= ESTIMATE:
                pairs.add((int(ids[k]), int(ids[j])))
    return pairs, ids[heads]


def candidates(members: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of the buckets' members (band, hash, rep, sig)."""
    found = []
    while True:
        sizes = checkpointed(members.groupBy("band", "hash").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK))
        dealt = members.join(sizes, ["band", "hash"], "left").withColumn("chunks", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(CHUNK)).cast("int"))
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(len(found))), F.col("chunks")).cast("int"))
        dealt = dealt.repartition("band", "hash", "chunk").sortWithinPartitions("band", "hash", "chunk", "rep")

        def work(batches):
            def close(part):
                key = np.stack([part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2)], axis=1)
                edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
                ids, many = part.column(3).to_numpy(), part.column(5).to_numpy()
                sig = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint32).reshape(len(ids), HASHES)
                pairs, ups = set(), []
                for lo, hi in zip(edges, edges[1:]):  # noqa: B905
                    more, heads = spanning(ids[lo:hi], sig[lo:hi]) if hi - lo > 1 else ((), ids[lo:hi])
                    pairs |= {(min(p), max(p)) for p in more if p[0] != p[1]}
                    if many[lo] > 1:
                        at = {int(i): k for k, i in enumerate(ids[lo:hi])}
                        ups += [(int(key[lo, 0]), int(key[lo, 1]), int(h), sig[lo + at[int(h)]].tobytes()) for h in heads]
                rows = [(a, b, None, None, None) for a, b in pairs] + [(rep, None, band, h, s) for band, h, rep, s in ups]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["a", "b", "band", "hash", "sig"])

            yield from by_groups(batches, 3, close)

        out = checkpointed(dealt.select("band", "hash", "chunk", "rep", "sig", "chunks").mapInArrow(work, "a long, b long, band int, hash long, sig binary"))
        found.append(out.where("b IS NOT NULL").select("a", "b"))
        up = out.where("b IS NULL").select("band", "hash", F.col("a").alias("rep"), "sig")
        # A bucket that does not shrink has no use for another level: step 6 takes all of its pairs.
        left = up.groupBy("band", "hash").agg(F.count("*").alias("up")).join(sizes, ["band", "hash"]).where("2 * up <= n").select("band", "hash")
        left = checkpointed(left)
        if left.limit(1).count() == 0:
            break
        members = checkpointed(up.join(left, ["band", "hash"], "left_semi"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets of over ``SMALL`` texts and more than one class, with their root; main: the bucket's main class."""
    large = checkpointed(members.groupBy("band", "hash").agg(F.count("*").alias("n")).where(F.col("n") > SMALL))
    held = members.join(large, ["band", "hash"]).join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    held = checkpointed(held.select("band", "hash", "n", "rep", "root", "sig"))
    parts = held.groupBy("band", "hash", "root").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    most = parts.groupBy("band", "hash").agg(F.max(F.struct("c", "root")).alias("m"), F.first("n").alias("n"))
    most = checkpointed(most.where(F.col("m.c") < F.col("n")).select("band", "hash", F.col("m.root").alias("main")))
    return checkpointed(held.join(most, ["band", "hash"]).select("band", "hash", "rep", "root", "main", "sig"))


def crossing(held: DataFrame, work, schema: str) -> DataFrame:
    """What ``work`` makes of the blocks of the buckets' pairs: texts outside the main class (side 0) by all texts (side 1).

    Columns: band, hash, i, j, side, rep, root, sig and, where ``held`` has it, set.
    """
    bulk = F.length("set") if "set" in held.columns else F.lit(0)
    outside = F.col("root") != F.col("main")

    def blocks(picked):
        return F.ceil(F.greatest(F.count(picked) / F.lit(BLOCK), F.sum(F.when(picked.isNotNull(), bulk)) / F.lit(BLOCK_BYTES), F.lit(1))).cast("int")

    sizes = held.groupBy("band", "hash").agg(blocks(F.when(outside, 1)).alias("left_blocks"), blocks(F.lit(1)).alias("right_blocks"), F.count(F.when(outside, 1)).alias("out"))
    dealt = held.join(checkpointed(sizes.where("out > 0").drop("out")), ["band", "hash"])

    def place_of(count: str, salt: int):
        return F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(count)).cast("int")

    def to_all(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    columns = ("band", "hash", "i", "j", "side", "rep", "root", "sig", *(["set"] if "set" in held.columns else []))
    left = dealt.where(outside).withColumn("i", place_of("left_blocks", 1)).withColumn("j", to_all("right_blocks")).withColumn("side", F.lit(0)).select(*columns)
    right = dealt.withColumn("j", place_of("right_blocks", 2)).withColumn("i", to_all("left_blocks")).withColumn("side", F.lit(1)).select(*columns)
    return left.unionByName(right).repartition("band", "hash", "i", "j").sortWithinPartitions("band", "hash", "i", "j", "side").mapInArrow(work, schema)


def block_pairs(part):
    """Of each block (lo, hi) in a table of whole blocks: for each text of side 0 its pairs of different roots with an estimate of ``ESTIMATE`` or more whose first shared bucket this is."""
    key = np.stack([part.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
    edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
    side, root = part.column(4).to_numpy(), part.column(6).to_numpy()
    sig = np.frombuffer(b"".join(part.column(7).to_pylist()), np.uint32).reshape(len(key), HASHES)
    for lo, hi in zip(edges, edges[1:]):  # noqa: B905
        mid = lo + int(np.searchsorted(side[lo:hi], 1))
        columns = np.ascontiguousarray(sig[mid:hi].T)
        for k in range(lo, mid):
            alike = np.zeros(hi - mid, np.uint8)
            for h in range(HASHES):
                alike += columns[h] == sig[k, h]
            other = np.flatnonzero((alike >= ESTIMATE * HASHES) & (root[mid:hi] != root[k]))
            other = mid + other[np.argsort(-alike[other].astype(np.int64), kind="stable")]
            if len(other):
                shared = (sig[other] == sig[k]).reshape(len(other), BANDS, ROWS).all(axis=2)
                yield lo, hi, k, other[shared.argmax(axis=1) == key[k, 0]]


def contested(held: DataFrame) -> DataFrame:
    """The distinct texts that have a pair to verify."""

    def close(part):
        rep, found = part.column(5).to_numpy(), set()
        for _, _, k, other in block_pairs(part):
            if len(other):
                found.add(int(rep[k]))
                found.update(rep[other].tolist())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["rep"])

    def work(batches):
        yield from by_groups(batches, 4, close)

    return crossing(held, work, "rep long").distinct()


class Sets:
    """The shingles of a block's texts, numbered within the block, and their weights."""

    def __init__(self, sets: list[bytes]):
        read = [weights(x) for x in sets]
        found, ids = np.unique(np.concatenate([a for a, _ in read]), return_inverse=True)
        self.ids = np.split(ids.astype(np.int32), np.cumsum([len(a) for a, _ in read])[:-1])
        self.weights = [w for _, w in read]
        self.totals = np.array([w.sum() for w in self.weights])
        self.own = np.zeros(len(found))

    def similarities(self, k: int, others: np.ndarray) -> np.ndarray:
        """The exact weighted Jaccard similarities of text k to the others; no text is without shingles."""
        ids, w = [self.ids[o] for o in others], np.concatenate([self.weights[o] for o in others])
        starts = np.cumsum([0, *(len(x) for x in ids[:-1])])
        self.own[self.ids[k]] = self.weights[k]
        shared = np.add.reduceat(np.minimum(self.own[np.concatenate(ids)], w), starts)
        self.own[self.ids[k]] = 0
        return shared / (self.totals[k] + self.totals[others] - shared)


def crossing_links(held: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between classes, verified inside the blocks; held has the texts' sets."""

    def close(part):
        rep, root, block, links = part.column(5).to_numpy(), part.column(6).to_numpy(), (0, 0), []
        for lo, hi, k, others in block_pairs(part):
            if (lo, hi) != block:
                block, sets, now = (lo, hi), Sets(part.column(8).slice(lo, hi - lo).to_pylist()), root[lo:hi].copy()
            k, others = k - lo, others - lo
            others = others[now[others] != now[k]]
            small, large = np.minimum(sets.totals[others], sets.totals[k]), np.maximum(sets.totals[others], sets.totals[k])
            others = others[small >= (similarity - 1e-9) * large]
            if len(others):
                for o in others[sets.similarities(k, others) >= similarity - 1e-9].tolist():
                    if now[o] != now[k]:
                        now[now == now[o]] = now[k]
                        links.append((int(rep[lo + k]), int(rep[lo + o])))
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def work(batches):
        yield from by_groups(batches, 4, close)

    return crossing(held, work, "a long, b long")


def by_groups(batches, keys: int, close):
    """What ``close`` yields of tables that hold whole groups of equal leading ``keys`` columns; the rows are sorted by them."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        part = part.combine_chunks()
        same = np.ones(part.num_rows, bool)
        for k in range(keys):
            key = part.column(k).to_numpy()
            same &= key == key[-1]
        cut = int(np.argmax(same))  # the last group may go on in the next batch
        if cut:
            yield from close(part.slice(0, cut).combine_chunks())
        held = part.slice(cut)
    if held is not None and held.num_rows:
        yield from close(held.combine_chunks())


def sets_of(docs: DataFrame, picked: DataFrame, idf) -> DataFrame:
    """rep and its set (ascending shingles of 4 bytes, then levels of 2 bytes) of the picked texts (rep, doc_id, name)."""
    picked = checkpointed(picked)
    few = picked.count() <= BROADCAST_IDS

    def sets(batches):
        words = WordHashes()
        for batch in batches:
            for step in steps([batch], step_bytes=STEP_BYTES):
                text, shingle, tf, names, _ = shingles(step.column(1).to_pylist(), words)
                level = np.minimum(levels(shingle, tf, idf.value), 65535).astype(np.uint16)
                cuts = np.searchsorted(text, np.arange(step.num_rows + 1))
                found = []
                for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905
                    short = (shingle[lo:hi] >> np.uint64(16)).astype(np.uint32)  # still ascending
                    found.append(short.tobytes() + level[lo:hi].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.binary())], names=["name", "set"])

    ids, names = picked.select(F.col("doc_id").alias("__id")).distinct(), picked.select("name", "rep")
    if few:
        ids, names = F.broadcast(ids), F.broadcast(names)
    whole = docs.join(ids, F.col("doc_id") == F.col("__id"), "left_semi").select("doc_id", "text").mapInArrow(sets, "name binary, set binary")
    return checkpointed(whole.join(names, "name").select("rep", "set").dropDuplicates(["rep"]))


def verified(docs: DataFrame, texts: DataFrame, pairs: DataFrame, idf, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose exact weighted Jaccard similarity is large enough, with it."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    whole = sets_of(docs, texts.join(ids, "rep", "left_semi").select("rep", "doc_id", "name"), idf)
    both = pairs.join(whole.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a").join(whole.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")

    def compare(batches):
        for batch in batches:
            sims = [jaccard(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])
            yield out.filter(pa.array(np.array(sims) >= similarity - 1e-9))

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, similarity double")


def weights(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(x) // 6
    return np.frombuffer(x, np.uint32, n), np.exp(np.frombuffer(x, np.uint16, n, 4 * n) / STEP)


def jaccard(x: bytes, y: bytes) -> float:
    """Weighted Jaccard similarity of two sets of ascending shingles and levels."""
    (a, wa), (b, wb) = weights(x), weights(y)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = b[at] == a
    shared = np.minimum(wa[hit], wb[at[hit]]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every linked node, by alternating stars."""
    tables = Tables(links.sparkSession)
    links = tables.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    parts = 1 + links.count() // LINKS  # no step makes more edges than there are links

    def written(df):
        return tables.write(df.coalesce(parts))

    edges, before = links, None
    while True:
        # The sides of each join are plain exchanges of written rows, so that a hub's rows can be split.
        both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct())
        tables.drop(but_last=1)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == before:
            roots = checkpointed(edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"))
            tables.drop()
            return roots
        before = now


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row per document: doc_id, class_id, n_words and kept (one document of each class)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    idf = spark.sparkContext.broadcast(log_idf(frequencies(docs), docs.count()))
    seen = checkpointed(sampled(docs, idf).withColumn("row", F.monotonically_increasing_id()))
    texts = seen.where("doc_id IS NOT NULL").groupBy("name").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies"))
    texts = checkpointed(texts.select("name", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("rep"), "copies"))
    reps = seen.select(F.col("row").alias("rep"), "n_words", "bands", "sig").join(texts.select("rep"), "rep", "left_semi").where("n_words > 0")
    bands = reps.select("rep", F.posexplode("bands").alias("band", "hash"))
    # Written out, so that the join's sides are plain exchanges and a bucket of many texts can be split.
    shared = checkpointed(bands.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1").select("band", "hash"))
    members = bands.join(shared, ["band", "hash"], "left_semi").join(reps.select("rep", "sig"), "rep")
    members = checkpointed(members.select("band", "hash", "rep", "sig"))
    pairs = checkpointed(candidates(members))
    roots = components(verified(docs, texts, pairs, idf, similarity))
    open_ = unsettled(members, roots)
    if open_.limit(1).count():
        asked = checkpointed(contested(open_))
        if asked.limit(1).count():
            sets = sets_of(docs, texts.join(asked, "rep", "left_semi").select("rep", "doc_id", "name"), idf)
            links = checkpointed(crossing_links(open_.join(sets, "rep"), similarity))
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
    # A class takes the least id of its texts; only texts that have copies or links meet the rows again.
    nodes = roots.select(F.col("node").alias("rep"), "root").unionByName(roots.select(F.col("root").alias("rep"), "root").distinct())
    nodes = checkpointed(nodes.join(texts.select("rep", "doc_id", "name"), "rep").select("root", "doc_id", "name"))
    least = checkpointed(nodes.groupBy("root").agg(F.min(F.struct("doc_id", "name")).alias("keep")))
    linked = nodes.join(least, "root").select("name", F.col("keep.doc_id").alias("class_id"), F.col("keep.name").alias("keep_name"))
    copies = texts.where("copies > 1").join(linked.select("name"), "name", "left_anti").select("name", F.col("doc_id").alias("class_id"), F.col("name").alias("keep_name"))
    classes = checkpointed(linked.unionByName(copies))
    out = seen.select("doc_id", "name", "n_words").join(classes, "name", "left")
    kept = F.col("doc_id").isNull() | F.col("class_id").isNull() | ((F.col("doc_id") == F.col("class_id")) & (F.col("name") == F.col("keep_name")))
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), "n_words", kept.alias("kept"))


def drop_near(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, in the documents' own columns."""
    return without(docs, ids_without_kept(near_classes(docs, **options)), options.get("id_col", "doc_id"))


QUERY = "op5_near_dedup"


def op5_near_dedup(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents"))
