"""SentencePiece encoding and decoding by suffix-array matching.

A step's distinct words (runs of blanks with what follows them) are put one after another. A
suffix array of that text, sorted as deep as the longest piece, is binary-searched for every
piece of the vocabulary; the ranges found are the edges of the words' lattices, which are sorted
by position. The lattice is then relaxed to the path that the model chooses. For the byte-pair
models read here that is not the path of the best sum: the best-scored edge over two
neighbouring symbols is taken again and again, the leftmost of equals. This is done for all
words at once, and with a heap for words over ``LONG`` characters.

Words never share a piece (no piece has a blank behind another character; a vocabulary that has
one is refused), so equal words have equal pieces and each worker remembers up to ``REMEMBER``.
The result equals the library's, id by id. The vocabulary is read from a model file on the
driver and travels with the tasks (fixed size); nothing is trained.

Defined results. Null and empty texts have no ids. Characters outside the vocabulary become
their UTF-8 bytes' ids. The blank mark U+2581 in a text is read as a blank, as the library does,
so such a text comes back with a blank. Null ids, repeated rows and extra columns pass.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from larkspur.llm.common import small_batches, steps, table, worker_state

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
LONG = 48
REMEMBER = 300_000
STEP_BYTES = 2 << 20


class Vocabulary:
    """The pieces of a byte-pair model with byte fallback."""

    def __init__(self, path: str = MODEL):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(k) for k in range(n)]
        self.score = np.array([model.get_score(k) for k in range(n)], np.float64)
        special = [model.is_control(k) or model.is_unknown(k) or model.is_byte(k) for k in range(n)]
        self.normal = np.array([k for k in range(n) if not special[k]], np.int64)
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.raw = [b"" if special[k] else p.encode() for k, p in enumerate(self.pieces)]
        for b, k in enumerate(self.byte_ids):
            self.raw[k] = bytes([b])
        if not all(model.is_byte(int(k)) for k in self.byte_ids):
            raise ValueError("a model without byte fallback is not read")
        if any(re.search(f"[^{BLANK}]{BLANK}", self.pieces[k]) for k in self.normal):
            raise ValueError("a piece with a blank behind another character is not read")
        self.longest = max(len(self.pieces[k]) for k in self.normal)
        alphabet = sorted(set("".join(self.pieces[k] for k in self.normal)))
        if self.longest > 31:
            raise ValueError("a piece of over 31 characters is not read")
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.chars = np.zeros((len(self.normal), self.longest), np.uint16)
        self.sizes = np.array([len(self.pieces[k]) for k in self.normal])
        for row, k in enumerate(self.normal):
            self.chars[row, : self.sizes[row]] = self.code[[ord(c) for c in self.pieces[k]]]
        apart = "" if "\n" in alphabet else "\n"
        self.word = re.compile(f"{BLANK}*[^{BLANK}{apart}]+|{BLANK}+" + (f"|{apart}" if apart else ""))

    def words(self, text: str) -> list[str]:
        return self.word.findall(BLANK + text.replace(" ", BLANK)) if text else []


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_array(codes: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of their next ``depth`` codes (0 beyond the end), and those codes packed into words."""
    per, n = 64 // bits, len(codes)
    padded = np.concatenate((codes.astype(np.uint64), np.zeros(depth + per, np.uint64)))
    keys = []
    for lo in range(0, depth, per):
        key = np.zeros(n, np.uint64)
        for k in range(per):
            key = (key << np.uint64(bits)) | (padded[lo + k : lo + k + n] if lo + k < depth else np.uint64(0))
        keys.append(key)
    # The first key alone decides most places; only runs of equal ones are sorted by the rest.
    order = np.argsort(keys[0])
    first = keys[0][order]
    equal = np.zeros(n, bool)
    equal[1:] = first[1:] == first[:-1]
    run = np.cumsum(~equal)
    equal[:-1] |= equal[1:]
    tied = np.flatnonzero(equal)
    if len(tied):
        own = order[tied]
        order[tied] = own[np.lexsort([k[own] for k in keys[:0:-1]] + [run[tied]])]
    return order, [k[order] for k in keys]


def occurrences(keys: list[np.ndarray], rows: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece (codes in rows) the range of the suffix array that starts with it, by binary search."""
    per = 64 // bits
    lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(keys[0]), np.int64)
    for part, key in enumerate(keys):
        own = rows[:, part * per : (part + 1) * per].astype(np.uint64)
        width = np.clip(sizes - part * per, 0, per)
        low = np.zeros(len(rows), np.uint64)
        for k in range(per):
            low = (low << np.uint64(bits)) | (own[:, k] if k < own.shape[1] else np.uint64(0))
        free = ((per - width) * bits).astype(np.uint64)
        high = np.where(width > 0, low | np.where(width < per, (np.uint64(1) << np.minimum(free, np.uint64(63))) - np.uint64(1), np.uint64(0)), low)
        live = np.flatnonzero((width > 0) & (hi > lo))
        if part == 0:
            lo[live], hi[live] = np.searchsorted(key, low[live], "left"), np.searchsorted(key, high[live], "right")
            continue
        for j in live:
            part_key = key[lo[j] : hi[j]]
            lo[j], hi[j] = lo[j] + np.searchsorted(part_key, low[j], "left"), lo[j] + np.searchsorted(part_key, high[j], "right")
    return lo, hi


def lattice(vocabulary: Vocabulary, text: str) -> tuple[np.ndarray, np.ndarray]:
    """piece ids by position and length (-1: none) of the text, and its characters; '\\0' in code 0 matches nothing."""
    chars = codes_of(text)
    codes = vocabulary.code[chars]
    seen = np.unique(codes)
    seen = seen[seen > 0]
    bits = 8 if len(seen) < 254 else 16
    compact = np.zeros(int(vocabulary.code.max()) + 1, np.uint16)
    compact[seen] = np.arange(2, len(seen) + 2)  # 0: beyond the end, 1: in no piece
    local = np.where(codes > 0, compact[codes], 1)
    rows = compact[vocabulary.chars]
    possible = np.flatnonzero(((rows > 0) | (vocabulary.chars == 0)).all(axis=1))
    rows, sizes, ids = rows[possible], vocabulary.sizes[possible], vocabulary.normal[possible]
    order, keys = suffix_array(local, vocabulary.longest, bits)
    lo, hi = occurrences(keys, rows, sizes, bits)
    n = np.maximum(hi - lo, 0)
    at = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    edges = (at.astype(np.int64) << 29) | (np.repeat(sizes, n) << 24) | np.repeat(ids, n)
    edges.sort()
    out = np.full((len(chars), vocabulary.longest), -1, np.int16 if len(vocabulary.pieces) < 1 << 15 else np.int32)
    out[edges >> 29, (edges >> 24 & 31) - 1] = edges & 0xFFFFFF
    return out, chars


def relax(vocabulary: Vocabulary, edges: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the chosen pieces start, for words that end at ``ends``; all words take their best edge at once."""
    n = len(edges)
    starts = np.ones(n, bool)
    sizes = np.diff(ends, prepend=0)
    for w in np.flatnonzero(sizes > LONG):
        _relax_long(vocabulary, edges, int(ends[w] - sizes[w]), int(ends[w]), starts)
    word = np.repeat(np.arange(len(ends)), sizes)
    live = np.flatnonzero((sizes <= LONG) & (sizes > 1))
    here = np.zeros(len(ends), bool)
    here[live] = True
    at = np.flatnonzero(here[word])
    while len(at):
        own = word[at]
        after = np.append(at[1:], n)
        paired = np.append(own[1:] == own[:-1], False)
        # The pair's end is the start of the symbol after the next one, or the word's end.
        stop = np.where(np.append(paired[1:], False), np.append(after[1:], n), ends[own])
        size = stop - at
        fits = paired & (size <= edges.shape[1])
        piece = np.where(fits, edges[at, np.minimum(size, edges.shape[1]) - 1], -1)
        score = np.where(piece >= 0, vocabulary.score[piece], -np.inf)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        best = np.maximum.reduceat(score, first)
        count = np.diff(np.append(first, len(at)))
        hit = np.flatnonzero((score == np.repeat(best, count)) & (piece >= 0))
        hit = hit[np.append(True, own[hit][1:] != own[hit][:-1])] if len(hit) else hit
        starts[at[hit + 1]] = False
        going = np.repeat(best > -np.inf, count)
        going[hit + 1] = False
        at = at[going]
    return starts


def _relax_long(vocabulary: Vocabulary, edges: np.ndarray, lo: int, hi: int, starts: np.ndarray) -> None:
    n = hi - lo
    nxt, prev, size, dead = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n, [False] * n
    heap: list = []

    def offer(i: int) -> None:
        j = nxt[i] if i >= 0 else n
        if i >= 0 and j < n and (width := size[i] + size[j]) <= edges.shape[1] and (piece := edges[lo + i, width - 1]) >= 0:
            heapq.heappush(heap, (-vocabulary.score[piece], i, size[i], size[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if dead[i] or j >= n or size[i] != a or size[j] != b:
            continue
        size[i], nxt[i], dead[j] = a + b, nxt[j], True
        starts[lo + j] = False
        if nxt[i] < n:
            prev[nxt[i]] = i
        offer(prev[i])
        offer(i)


def encode_words(vocabulary: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and how many each has."""
    edges, chars = lattice(vocabulary, "".join(words))
    ends = np.cumsum([len(w) for w in words])
    # No edge may reach over its word's end.
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(chars))
    edges[np.arange(1, edges.shape[1] + 1)[None, :] > left[:, None]] = -1
    starts = np.flatnonzero(relax(vocabulary, edges, ends))
    size = np.diff(np.append(starts, len(chars)))
    ids = edges[starts, size - 1]
    count = np.ones(len(starts), np.int64)
    lost = np.flatnonzero(ids < 0)  # single characters outside the vocabulary
    encoded = [chr(chars[starts[k]]).encode("utf-8", "surrogatepass") for k in lost]
    count[lost] = [len(e) for e in encoded]
    out = np.repeat(ids, count)
    where = np.cumsum(count) - count
    for k, e in zip(lost, encoded, strict=True):
        out[where[k] : where[k] + len(e)] = vocabulary.byte_ids[list(e)]
    per = np.add.reduceat(count, np.searchsorted(starts, ends - np.diff(ends, prepend=0))) if len(words) else count
    return out.astype(np.int32), per


class Encoder(dict):
    """word -> its number; remembers the ids of the words that it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.fresh.append(word)
        return k

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self) > REMEMBER:
            self._forget()
        parts = []
        for t in texts:
            words = self.vocabulary.words(t)
            parts.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        if self.fresh:
            ids, count = encode_words(self.vocabulary, self.fresh)
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
            self.flat, self.count, self.fresh = np.concatenate((self.flat, ids)), np.concatenate((self.count, count)), []
        sizes = np.array([len(p) for p in parts], np.int64)
        word = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        n = self.count[word]
        ends = np.cumsum(n)
        out = self.flat[np.repeat(self.start[word] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.append(0, ends)[np.cumsum(sizes)]
        return out, np.diff(upto, prepend=0)


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of ids: pieces and bytes joined, broken UTF-8 replaced, the first blank dropped."""
    text = b"".join(map(vocabulary.raw.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
    return text[1:] if text[:1] == " " else text


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder, kept between tasks of the same vocabulary."""
    return worker_state(("pieces", len(vocabulary.pieces), vocabulary.pieces[-1], vocabulary.pieces[len(vocabulary.pieces) // 2]), lambda: Encoder(vocabulary))


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens and token_ids of every document, in place."""
    small_batches(docs.sparkSession)
    picked = docs.select(*keep, docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def rows(batches):
        own = encoder(shared.value)
        for batch in batches:
            for step in steps([batch], step_bytes=STEP_BYTES):
                ids, n = own.encode(step.column(len(keep)).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*step.columns[: len(keep)], pa.array(n, pa.int64()), lists], names=[*keep, "n_tokens", "token_ids"])

    return picked.mapInArrow(rows, f"{schema}, n_tokens long, token_ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "token_ids", key: str = "doc_id") -> DataFrame:
    """key and text of every row of ids; null lists give empty texts."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(shared.value, ids or []) for ids in batch.column(1).to_pylist()])], names=[key, "text"])

    picked = encoded.select(key, ids_col)
    return picked.mapInArrow(rows, f"{key} {picked.schema[key].dataType.simpleString()}, text string")


QUERY = "op1_sentencepiece"


def op1_sentencepiece(spark, sf_dir):
    """Every text encoded and decoded again: doc_id, n_tokens, n_byte_tokens, ids_sha256 (32-bit little-endian ids), decoded_sha256, round_trip."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary())

    def rows(batches):
        v = shared.value
        own, is_byte = encoder(v), np.zeros(len(v.pieces), bool)
        is_byte[v.byte_ids] = True
        for batch in batches:
            for step in steps([batch], step_bytes=STEP_BYTES):
                texts = step.column(1).to_pylist()
                ids, n = own.encode(texts)
                parts = np.split(ids, np.cumsum(n)[:-1])
                back = [decode(v, p.tolist()) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        step.column(0), pa.array(n, pa.int64()), pa.array([int(is_byte[p].sum()) for p in parts], pa.int64()), pa.array([hashlib.sha256(p.astype("<i4").tobytes()).hexdigest() for p in parts]),
                        pa.array([hashlib.sha256(b.encode("utf-8", "replace")).hexdigest() for b in back]), pa.array([b == t.replace(BLANK, " ") for b, t in zip(back, texts, strict=True)]),
                    ],
                    names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
                )

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(rows, "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
