"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has a node between any two characters and an edge for every vocabulary piece that matches. A
segmentation's weight is the product of its pieces' weights to the power theta. Forward filtering sums the weights of
all paths to each node; backward sampling walks from the end and picks each last piece with its exact posterior.
No piece spans the gap before a word mark, or a character that occurs in no longer piece, so the lattice falls apart
there: the forward pass runs once per distinct stretch of a batch, the backward pass for every occurrence. Each draw
is a hash of (seed, row key, place in the text), so results do not depend on partitions, batches or retries.

Characters without a piece, and a literal word mark in the text, are written as byte pieces, so decoding restores the
text exactly; op1 decodes every row and compares. A stretch of over CHUNK_CHARS characters in which any place can lie
inside a piece has its lattice built block by block, with the forward sums carried over each cut.

Defined results: null or empty text has no pieces; a null row key is replaced by the text's CRC-32; repeated rows get
repeated segmentations; columns beside the named ones are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import only, slices, table, tidy

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
THETA = 0.7
SEED = 20240311
CHUNK_CHARS = 1_500_000

_MARK = 0x2581
_LITERAL_MARK = 0x110001
_CODES = 0x110002

SCHEMA = "doc_id long, n_pieces long, pieces array<int>, lossless boolean"


@dataclass(frozen=True)
class Pieces:
    """What the sampler needs of a vocabulary; plain values that travel to executors once (its size is the model's)."""

    text: list[str | None]  # None: not a piece of the lattice
    log_weight: list[float]
    byte_ids: list[int]
    theta: float

    @classmethod
    def load(cls, path: str, theta: float = THETA) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        text = [None if s else model.id_to_piece(i) for i, s in enumerate(special)]
        score = [model.get_score(i) for i in range(n)]
        ranks = sorted(-s for s, x in zip(score, special, strict=True) if not x)
        if ranks == [float(k) for k in range(len(ranks))]:
            # a merge-ranked vocabulary has no probabilities; by Zipf's law rank r weighs 1 / (r + 1)
            score = [-float(np.log1p(max(-s, 0.0))) for s in score]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in byte_ids):
            raise ValueError("the model has no byte pieces, so characters outside its vocabulary would be lost")
        return cls(text, score, byte_ids, theta)

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys node * 2^21 + code, next nodes, piece id at each node or -1)."""
        edges: dict[int, int] = {}
        ends = [-1]
        for i, piece in enumerate(self.text):
            if not piece:
                continue
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            ends[node] = i
        keys = np.array(sorted(edges), np.int64)
        return keys, np.array([edges[k] for k in keys.tolist()], np.int64), np.array(ends, np.int64)

    @cached_property
    def joins(self) -> np.ndarray:
        """For each code point whether it occurs in a piece of several characters."""
        found = np.zeros(_CODES, bool)
        for piece in self.text:
            if piece and len(piece) > 1:
                if any(b == "▁" != a for a, b in zip(piece, piece[1:], strict=False)):
                    raise ValueError("a piece spans a word gap")
                found[[ord(c) for c in piece]] = True
        return found

    @cached_property
    def longest(self) -> int:
        """Characters of the longest piece."""
        return max(len(t or "") for t in self.text)

    @cached_property
    def octets(self) -> list[bytes]:
        """The bytes each id decodes to."""
        table_ = [(t or "").replace("▁", " ").encode() for t in self.text]
        for b, i in enumerate(self.byte_ids):
            table_[i] = bytes([b])
        return table_

    @cached_property
    def weights(self) -> np.ndarray:
        return np.array(self.log_weight) * self.theta

    @cached_property
    def byte_weight(self) -> float:
        return float(self.weights.min() - self.theta)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, np.uint64(0x9E3779B97F4A7C15 | 1))]), dtype=np.uint64)
    return _POWERS[:n]


def _distinct(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one stretch per content, for each stretch its content's number)."""
    inside = np.arange(len(codes)) - np.repeat(starts, sizes)
    terms = _mixed(codes.astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max()))[inside]
    sums = np.add.reduceat(terms, starts) ^ _mixed(sizes.astype(np.uint64))
    _, first, which = np.unique(sums, return_index=True, return_inverse=True)
    return first, which


def _lattice(codes: np.ndarray, left: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (start, length, piece id or -1 for bytes) over stretches laid end to end; left: characters that remain
    in the stretch from each place on."""
    keys, follow, ends = pieces.trie
    at, node = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.int64)
    starts, lengths, ids = [], [], []
    single = np.zeros(len(codes), bool)
    size = 0
    while len(at):
        key = node << 21 | codes[at + size]
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[found] == key
        at, node = at[hit], follow[found[hit]]
        size += 1
        piece = ends[node]
        full = piece >= 0
        starts.append(at[full])
        lengths.append(np.full(int(full.sum()), size, np.int32))
        ids.append(piece[full].astype(np.int32))
        if size == 1:
            single[at[full]] = True
        longer = left[at] > size
        at, node = at[longer], node[longer]
    bare = np.flatnonzero(~single).astype(np.int32)
    one, none = np.ones(len(bare), np.int32), np.full(len(bare), -1, np.int32)
    return np.concatenate([*starts, bare]), np.concatenate([*lengths, one]), np.concatenate([*ids, none])


def _octet_count(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF) - (codes == _LITERAL_MARK)


def _sample(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, places: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first character, piece) of every sampled piece in text order. keys and places: for each stretch the
    hash of its row and the place of its first character in the row's text."""
    first, which = _distinct(codes, starts, sizes)
    own_sizes = sizes[first]
    own_starts = np.cumsum(own_sizes) - own_sizes
    inside = np.arange(int(own_sizes.sum())) - np.repeat(own_starts, own_sizes)
    own = codes[np.repeat(starts[first], own_sizes) + inside]
    edge_at, edge_len, edge_id = _lattice(own, np.repeat(own_sizes, own_sizes) - inside, pieces)
    weight = np.where(edge_id >= 0, pieces.weights[edge_id], pieces.byte_weight * _octet_count(own[edge_at]))
    head = edge_at + np.repeat(np.arange(len(first), dtype=np.int32), own_sizes)[edge_at]  # nodes: one more than characters in each stretch
    tail = head + edge_len
    offset = inside.astype(np.int32)[edge_at] + edge_len
    del edge_at, edge_len
    order = np.lexsort((-weight, tail, offset))
    head, tail, offset, weight, edge_id = head[order], tail[order], offset[order], weight[order], edge_id[order]
    total = np.zeros(len(own) + len(first))
    group = np.flatnonzero(np.concatenate([[True], tail[1:] != tail[:-1]]))
    group_step = offset[group]
    bounds = np.searchsorted(group_step, np.arange(1, int(own_sizes.max()) + 2))
    edge_bounds = np.append(group, len(tail))
    ends_at = tail[group]
    path = np.empty(len(tail))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        low, high = int(edge_bounds[a]), int(edge_bounds[b])
        if low == high:
            continue
        path[low:high] = total[head[low:high]] + weight[low:high]
        total[tail[group[a:b]]] = np.logaddexp.reduceat(path[low:high], group[a:b] - low)
    path -= total[tail]
    run = np.exp(path, out=path)
    del path, weight, tail, offset, order
    # thresholds add up inside each node, so rounding cannot depend on what else is in the batch
    last, edge = edge_bounds[1:] - 1, group
    while len(edge):
        more = edge < last
        edge, last = edge[more] + 1, last[more]
        run[edge] += run[edge - 1]
    run[edge_bounds[1:] - 1] = 2.0  # the last edge of a node takes what rounding leaves
    opens = np.zeros(len(total), np.int64)
    opens[ends_at] = group

    node0 = own_starts + np.arange(len(first))
    base_node = node0[which]
    node = base_node + own_sizes[which]
    alive = np.arange(len(which))
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    counts = np.zeros(len(which), np.int64)
    while len(alive):
        here = node[alive]
        place = here - base_node[alive] + places[alive]
        draw = _mixed(keys[alive] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
        u = draw.astype(np.float64) * 2.0**-53
        edge = opens[here]
        more = np.flatnonzero(run[edge] <= u)
        while len(more):
            edge[more] += 1
            more = more[run[edge[more]] <= u[more]]
        back = head[edge]
        steps.append((alive, edge_id[edge], back - base_node[alive]))
        counts[alive] += 1
        node[alive] = back
        alive = alive[back > base_node[alive]]
    ends = np.cumsum(counts)
    out_id, out_at = np.empty(int(ends[-1]), np.int64), np.empty(int(ends[-1]), np.int64)
    for k, (who, piece, at) in enumerate(steps):
        slot = ends[who] - 1 - k
        out_id[slot] = piece
        out_at[slot] = at
    owner = np.repeat(np.arange(len(which)), counts)
    return owner, starts[owner] + out_at, out_id


def _sample_long(codes: np.ndarray, key: np.uint64, place: int, pieces: Pieces, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first character, piece) of the sampled pieces of one stretch, its lattice built block by block: once to carry the
    forward sums over every cut, and once more, from the end, to draw. Only the sums are held for the whole stretch; they
    and the draws are those of _sample."""
    total = np.zeros(len(codes) + 1)
    block = max(block, pieces.longest)

    def edges(low: int, high: int, known: bool) -> tuple[np.ndarray, ...]:
        """Edges into the nodes above low up to high: (bounds of the nodes' edges, heads, pieces, thresholds)."""
        first = max(low - pieces.longest + 1, 0)
        own = codes[first:high]
        at, size, piece = _lattice(own, np.arange(len(own), 0, -1), pieces)
        inside = at + size + first > low
        at, size, piece = at[inside], size[inside], piece[inside]
        weight = np.where(piece >= 0, pieces.weights[piece], pieces.byte_weight * _octet_count(own[at]))
        head = at.astype(np.int64) + first
        tail = head + size
        order = np.lexsort((-weight, tail))
        head, tail, weight, piece = head[order], tail[order], weight[order], piece[order]
        bounds = np.searchsorted(tail, np.arange(low + 1, high + 2))
        if not known:
            for node, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), low + 1):
                total[node] = np.logaddexp.reduce(total[head[a:b]] + weight[a:b])
            return ()
        run = np.exp(total[head] + weight - total[tail])
        edge, last = bounds[:-1], bounds[1:] - 1
        while len(edge):
            more = edge < last
            edge, last = edge[more] + 1, last[more]
            run[edge] += run[edge - 1]
        run[bounds[1:] - 1] = 2.0
        return bounds, head, piece, run

    lows = list(range(0, len(codes), block))
    for low in lows:
        edges(low, min(low + block, len(codes)), False)
    at, ids, node = [], [], len(codes)
    for low in reversed(lows):
        bounds, head, piece, run = edges(low, min(low + block, len(codes)), True)
        nodes = np.arange(low + 1, min(low + block, len(codes)) + 1, dtype=np.uint64)
        draws = (_mixed(key + (nodes + np.uint64(place)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        while node > low:
            edge, u = int(bounds[node - low - 1]), draws[node - low - 1]
            while run[edge] <= u:
                edge += 1
            node = int(head[edge])
            at.append(node)
            ids.append(int(piece[edge]))
    return np.array(at[::-1], np.int64), np.array(ids[::-1], np.int64)


def _codes(text: str) -> np.ndarray:
    """Code points with spaces as word marks; a mark that the text itself holds is told apart."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[codes == _MARK] = _LITERAL_MARK
    codes[codes == 0x20] = _MARK
    return codes


def _fresh(codes: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Whether no piece spans the gap before each character."""
    alone = ~pieces.joins[codes]
    return (codes == _MARK) & (np.roll(codes, 1) != _MARK) | alone | np.roll(alone, 1)


def _cut(text: str, most: int, pieces: Pieces) -> list[tuple[int, str]]:
    """(place, part) of a text: parts of at most `most` characters, cut where no piece can span. A stretch without such
    a place is a part of its own, whatever its length. Places count the mark that the model puts before the text."""
    if len(text) < most:
        return [(0, text)] if text else []
    gaps = np.append(np.flatnonzero(_fresh(_codes(" " + text), pieces)), len(text) + 1)
    parts, low = [], 0
    while low <= len(text):
        k = max(int(np.searchsorted(gaps, low + most, side="right")) - 1, int(np.searchsorted(gaps, low, side="right")))
        parts.append((low, text[max(low - 1, 0) : int(gaps[k]) - 1]))
        low = int(gaps[k])
    return parts


def row_hash(keys: list[int | None], texts: list[str], seed: int) -> np.ndarray:
    plain = [zlib.crc32(t.encode()) if k is None else k & (1 << 64) - 1 for k, t in zip(keys, texts, strict=True)]
    return _mixed(np.array(plain, np.uint64) ^ _mixed(np.full(len(plain), seed, np.uint64)))


def encode(texts: list[str], keys: list[int | None], pieces: Pieces, seed: int = SEED, chunk: int = CHUNK_CHARS) -> list[np.ndarray]:
    """Sampled piece ids of each text. The chunk bounds the lattice that is held at a time; no draw depends on it."""
    if chunk < 2:
        raise ValueError("a chunk must have at least two characters")
    hashes = row_hash(keys, texts, seed)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    group: list[tuple[int, str, int]] = []
    size = 0

    def flush() -> None:
        if group:
            for (i, _, _), ids in zip(group, _encode_parts(group, hashes, pieces, chunk), strict=True):
                found[i].append(ids)
            group.clear()

    for i, text in enumerate(texts):
        for place, part in _cut(text, chunk, pieces):
            if size + len(part) > chunk:
                flush()
                size = 0
            group.append((i, part, place))
            size += len(part)
    flush()
    return [np.concatenate(f) if f else np.zeros(0, np.int32) for f in found]


def _encode_parts(group: list[tuple[int, str, int]], hashes: np.ndarray, pieces: Pieces, chunk: int) -> list[np.ndarray]:
    # the model puts one word mark before a text; later parts of a long text begin where it was cut
    marked = [(" " if place == 0 else "") + part for _, part, place in group]
    codes = _codes("".join(marked))
    lengths = np.array([len(m) for m in marked])
    ends = np.cumsum(lengths)
    fresh = _fresh(codes, pieces)
    fresh[ends - lengths] = True
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(codes)))
    part = np.searchsorted(ends, starts, side="right")
    rows = np.array([i for i, _, _ in group])
    base = np.array([place for _, _, place in group])
    if len(starts) == 1 and len(codes) > chunk:
        at, ids = _sample_long(codes, hashes[rows[0]], int(base[0]), pieces, chunk)
        owner = np.zeros(len(at), np.int64)
    else:
        owner, at, ids = _sample(codes, starts, sizes, hashes[rows][part], starts - (ends - lengths)[part] + base[part], pieces)
    owner = part[owner]
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        octets = [("▁" if c == _LITERAL_MARK else chr(c)).encode("utf-8", "surrogatepass") for c in codes[at[bare]].tolist()]
        width = np.ones(len(ids), np.int64)
        width[bare] = [len(o) for o in octets]
        slot = (np.cumsum(width) - width)[bare]
        ids, owner = np.repeat(ids, width), np.repeat(owner, width)
        for s, o in zip(slot.tolist(), octets, strict=True):
            ids[s : s + len(o)] = [pieces.byte_ids[b] for b in o]
    cuts = np.searchsorted(owner, np.arange(1, len(group)))
    return np.split(ids.astype(np.int32), cuts)


def decode(ids: np.ndarray, pieces: Pieces) -> bytes:
    """The text's UTF-8 bytes: pieces end to end without the mark that the model put first."""
    return b"".join(map(pieces.octets.__getitem__, ids.tolist()))[1:]


# --- on tables -----------------------------------------------------------------------------------------------------


def encode_documents(documents: DataFrame, model: str = MODEL_PATH, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """Per document its sampled pieces, and whether decoding them gives the text back: see SCHEMA."""
    shared = documents.sparkSession.sparkContext.broadcast(Pieces.load(model, theta))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in slices(batches, most_bytes=2_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = encode(texts, batch.column("doc_id").to_pylist(), pieces, seed)
            same = [decode(ids, pieces) == t.encode() for ids, t in zip(found, texts, strict=True)]
            sizes = np.array([len(f) for f in found])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found))), pa.array(same)],
                ["doc_id", "n_pieces", "pieces", "lossless"],
            )

    return only(documents, "doc_id", "text").mapInArrow(tidy(rows), SCHEMA)


def decode_documents(encoded: DataFrame, model: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) from rows (doc_id, pieces)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(np.array(p or [], np.int32), shared.value).decode() for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return only(encoded, "doc_id", "pieces").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(rows), "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
