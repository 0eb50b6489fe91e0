"""Packing: order-preserving dynamic programming over document and sentence boundaries.

Documents are encoded in the order of their partition and laid end to end, each
followed by the end id. A window may end after a document (free), after a
sentence or line (``sentence_cost``), or, inside a sentence longer than
``max_sentence`` tokens, at every such step (``hard_cost``). The cost of a packing
is its padding plus those truncation penalties. For a cut at position p_j,

    best_j = cost_j + size - p_j + min over p_i >= p_j - size of (best_i + p_i),

so the transitions are a sliding-window minimum, kept in a monotone queue: linear
in the cut candidates.

Each partition streams: once ``block_windows`` windows' worth of tokens are held,
the cheapest prefix that ends within the last window is emitted and the rest is
carried on, so memory is bounded by a block and the longest document, and only
the last sequence of a partition is short. Nothing is shuffled; a retried task
repeats its own partition, whose number is the upper part of its sequence ids.

Defined cases: a null or empty text is a document of the end id alone; a null id
stays null; repeated rows are documents of their own; an empty table gives an
empty result; a document longer than a window spans several sequences.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .tokens import MERGES, RANKS, encoder

END_ID = 1
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_SEQUENCES_PER_PARTITION_BITS = 40
#: Ids looked at together for cuts, and ids of texts held to be used again.
_CHUNK_IDS, _KNOWN_IDS = 1 << 17, 1 << 21


@dataclass(frozen=True)
class Packing:
    size: int = 2048
    sentence_cost: float = 4.0
    hard_cost: float = 24.0
    max_sentence: int = 32
    block_windows: int = 256


def cut_candidates(flat: np.ndarray, ends: np.ndarray, enc, p: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which documents laid end to end, each with its end id, may be cut, and their costs.

    ``ends`` are the positions behind the documents' end ids.
    """
    last = ends - 1
    space = enc.starts_space[flat]
    space[last] = False
    cut = enc.ends_line[flat]
    cut[:-1] |= enc.ends_sentence[flat[:-1]] & space[1:]
    cut[last] = False
    at = np.flatnonzero(cut) + 1
    bounds = np.sort(np.concatenate(([0], at, ends)))
    steps = (np.diff(bounds) - 1) // p.max_sentence      # hard cuts inside each stretch without another
    each = np.repeat(np.arange(len(steps)), steps)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(steps) - steps, steps) + 1
    hard = bounds[:-1][each] + nth * p.max_sentence
    pos = np.concatenate((at, hard, ends))
    cost = np.repeat([p.sentence_cost, p.hard_cost, 0.0], (len(at), len(hard), len(ends)))
    order = np.argsort(pos, kind="stable")
    return pos[order], cost[order]


def best_cuts(pos: list[int], cost: list[float], size: int, final: bool) -> list[int]:
    """Positions of the cheapest packing's cuts; ``final``: it must end at the last candidate.

    Otherwise it ends at the cheapest candidate in the last ``size`` tokens.
    """
    best, back = [0.0] * len(pos), [-1] * len(pos)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, -1)])  # (best_i + p_i, p_i, i)
    for j, p in enumerate(pos):
        while queue[0][1] < p - size:
            queue.popleft()
        value, _, i = queue[0]
        b = best[j] = cost[j] + size - p + value
        back[j] = i
        value = b + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    j = len(pos) - 1
    if not final:
        floor = pos[-1] - size
        k = j
        while k >= 0 and pos[k] > floor:
            if best[k] < best[j]:
                j = k
            k -= 1
    cuts = []
    while j >= 0:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


class _Block:
    """Documents waiting to be packed, the first of them perhaps in part."""

    def __init__(self, first_sequence: int, p: Packing):
        self.p, self.sequence = p, first_sequence
        self.docs: list[tuple] = []  # (doc_id, ids, tokens already emitted, cut positions, cut costs)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, pos: np.ndarray, cost: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0, pos, cost))
        self.held += len(ids)

    def emit(self, final: bool) -> list[tuple]:
        starts, pos, cost, at = [], [], [], 0
        for _, ids, done, cuts, costs in self.docs:
            starts.append(at)
            keep = cuts > done
            pos.append(cuts[keep] - done + at)
            cost.append(costs[keep])
            at += len(ids) - done
        cuts = best_cuts(np.concatenate(pos).tolist(), np.concatenate(cost).tolist(), self.p.size, final)
        out, k, begin = [], 0, 0
        for end in cuts:
            x = begin
            while x < end:
                doc_id, ids, done, _, _ = self.docs[k]
                local = done + x - starts[k]
                n = min(end - x, len(ids) - local)
                piece = np.ascontiguousarray(ids[local:local + n], dtype="<u4")
                out.append((doc_id, local, n, zlib.crc32(piece), len(ids), self.sequence, x - begin))
                x += n
                if local + n == len(ids):
                    k += 1
            self.sequence += 1
            begin = end
        rest = self.docs[k:]
        if rest:
            doc_id, ids, done, pos0, cost0 = rest[0]
            rest[0] = (doc_id, ids, done + max(0, begin - starts[k]), pos0, cost0)
        self.docs, self.held = rest, at - begin
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", packing: Packing = Packing(),
         ranks: str = RANKS, merges: str = MERGES) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""
    ship_package(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    def encoded(batches: Iterator[pa.RecordBatch], enc) -> Iterator[tuple]:
        """(id, ids with the end id, cut positions, cut costs) of each document; a text met again lately is not encoded again."""
        end, known, held = np.array([END_ID], np.uint32), {}, 0
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1)
            k = 0
            while k < len(keys):
                some, size, begin = [], 0, k
                while k < len(keys) and size < _CHUNK_IDS:
                    text = texts[k].as_py() or ""
                    ids = known.get(text)
                    if ids is None:
                        if held > _KNOWN_IDS:
                            known, held = {}, 0
                        ids = known[text] = enc.ids(text)
                        held += len(ids)
                    some += [ids, end]
                    size += len(ids) + 1
                    k += 1
                flat = np.concatenate(some)
                ends = np.cumsum([len(x) + 1 for x in some[::2]])
                pos, cost = cut_candidates(flat, ends, enc, packing)
                to = np.searchsorted(pos, ends, side="right")
                lo = at = 0
                for key, stop, hi in zip(keys[begin:k], ends.tolist(), to.tolist()):
                    yield key, flat[lo:stop], pos[at:hi] - lo, cost[at:hi]
                    lo, at = stop, hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(TaskContext.get().partitionId() << _SEQUENCES_PER_PARTITION_BITS, packing)
        for doc in encoded(batches, encoder(ranks, merges)):
            block.add(*doc)
            if block.held >= packing.block_windows * packing.size:
                yield batch(block.emit(final=False))
        if block.docs:
            yield batch(block.emit(final=True))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def padding(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """(sequences, tokens, padded): padding fills a sequence up to ``size``, but none at a power of two."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    whole = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return used.agg(F.count(F.lit(1)).alias("sequences"), F.sum("used").alias("tokens"),
                    F.sum(F.when(whole, 0).otherwise(size - F.col("used"))).alias("padded"))
