"""Token counts of fields or sections by attribution of whole-document tokens.

A document is encoded once. Every token covers a span of the text's bytes; the spans are joined
to the sections' spans by their ordered bounds, and a token that crosses a bound is allocated by
an explicit rule:

* ``first``: all of it to the section that holds its first byte;
* ``largest``: all of it to the section with most of its bytes, the earlier one of equals;
* ``split``: to each section the share of its bytes.

So the counts of a document's sections always add up to its tokens. Spans are in characters,
ordered and disjoint; text between or around them forms sections of its own (index None in
``sections``' rows), so that no token is lost. Encoders are byte-level BPE ranks of a public
vocabulary; nothing is trained.

Defined results. Null and empty texts have no tokens and no sections; a zero-length section
has 0; the newline belongs to the line that it ends. Null ids, repeated rows and extra columns
pass. A long text is one step of its own.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from larkspur.llm.common import small_batches, steps, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULE = "largest"


class Encoder:
    """A rank file as an encoder that also knows each token's bytes; travels by its file's content."""

    def __init__(self, path: str = RANKS):
        with open(path, "rb") as f:
            self.data = f.read()
        self._made = None

    def __getstate__(self):
        return {"data": self.data, "_made": None}

    def made(self):
        if self._made is None:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}
            sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            for piece, k in ranks.items():
                sizes[k] = len(piece)
            self._made = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
        return self._made

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.made()[0].encode_to_numpy(text, disallowed_special=())).astype(np.int64)


def byte_bounds(text: str, bounds: np.ndarray) -> np.ndarray:
    """Places in characters as places in the text's UTF-8 bytes."""
    if text.isascii():
        return bounds
    raw = np.frombuffer(text.encode(), np.uint8)
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    return starts[bounds]


def attribute(sizes: np.ndarray, bounds: np.ndarray, rule: str = RULE) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a bound.

    sizes: bytes of the tokens in order; bounds: ends of the sections in bytes, ascending, the
    last one the text's end.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    upto = np.searchsorted(starts, bounds, "left")  # tokens whose first byte lies before the bound
    counts = np.diff(upto, prepend=0).astype(np.float64)
    last = upto - 1
    over = np.unique(last[(last >= 0) & (ends[np.maximum(last, 0)] > bounds)])
    if rule == "first" or not len(over):
        return counts, len(over)
    lo = np.searchsorted(bounds, starts[over], "right")
    hi = np.searchsorted(bounds, ends[over] - 1, "right")
    n = hi - lo + 1
    token = np.repeat(np.arange(len(over)), n)
    section = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    begin = np.where(section > 0, bounds[np.maximum(section - 1, 0)], 0)
    share = np.minimum(bounds[section], ends[over][token]) - np.maximum(begin, starts[over][token])
    np.subtract.at(counts, lo, 1.0)
    if rule == "split":
        np.add.at(counts, section, share / sizes[over][token])
    elif rule == "largest":
        first = np.lexsort((section, -share, token))[np.cumsum(n) - n]
        np.add.at(counts, section[first], 1.0)
    else:
        raise ValueError(f"no such rule: {rule}")
    return counts, len(over)


def line_ends(text: str) -> np.ndarray:
    """Ends, in characters, of the text's lines; a newline belongs to the line that it ends."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.array(ends, np.int64)


def count_sections(text: str, encoder: Encoder, rule: str = RULE, bounds: np.ndarray | None = None) -> tuple[int, np.ndarray, int]:
    """The text's tokens, those of each section (lines unless bounds are given), and the crossing ones."""
    if not text:
        return 0, np.zeros(0 if bounds is None else len(bounds)), 0
    ids = encoder.encode(text)
    where = byte_bounds(text, line_ends(text) if bounds is None else bounds)
    counts, crossing = attribute(encoder.made()[1][ids], where, rule)
    return len(ids), counts, crossing


def sections(docs: DataFrame, encoder: Encoder, rule: str = RULE, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """A row per document and section: id, section (place in spans, null for text outside them), start, stop, tokens.

    spans_col: array<struct<start int, stop int>> in characters; lines where it is not given.
    """
    small_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *([docs[spans_col].alias("spans")] if spans_col else []))
    kind = picked.schema["id"].dataType.simpleString()

    def rows(batches):
        for batch in steps(batches):
            out = []
            given = batch.column(2).to_pylist() if spans_col else [None] * batch.num_rows
            for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), given, strict=True):
                if spans_col:
                    edges, at = [], 0
                    for k, s in enumerate(spans or []):
                        if s["start"] > at:
                            edges.append((None, at, s["start"]))
                        edges.append((k, s["start"], s["stop"]))
                        at = s["stop"]
                    if at < len(text):
                        edges.append((None, at, len(text)))
                else:
                    ends = line_ends(text).tolist()
                    edges = [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], ends))]  # noqa: B905
                _, counts, _ = count_sections(text, encoder, rule, np.array([b for _, _, b in edges], np.int64))
                out += [(key, k, a, b, float(c)) for (k, a, b), c in zip(edges, counts, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64()], strict=True)], names=["id", "section", "start", "stop", "tokens"])

    return picked.mapInArrow(rows, f"id {kind}, section int, start int, stop int, tokens double")


QUERY = "op7_token_counts"


def op7_token_counts(spark, sf_dir):
    """Tokens of every document and of each of its lines."""
    small_batches(spark)
    encoder = Encoder()

    def rows(batches):
        for batch in steps(batches):
            found = [count_sections(t, encoder) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([len(f[1]) for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))],
                names=["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
            )

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(rows, "doc_id long, n_tokens long, n_sections int, n_crossing int, section_tokens array<int>")
