"""Mixture-controlled packing of documents into sequences of fixed length.

Every source (column `source`) is a queue: the concatenation of its
documents' tokens. A deficit round-robin serves the queues. In each round,
worth one sequence, a queue's deficit grows by its quantum, the queue's target
share of a sequence; it then sends as many chunks of `chunk` tokens as the
deficit pays for, and carries the rest of the deficit into the next round.
What the rounds send, in order, is cut into sequences of `length` tokens. When
a queue is empty, its share falls to the others, with their deficits carried.
The default targets are the queues' own shares, so all of them last to the end.

More than `FANOUT` sources form groups of about the square root of their
number, in the order of their names: a group's sources are served in the same
way, and what they send is the group's queue. So the work for a chunk grows
with that root, and every source keeps its own share.

A queue's state after round r is a linear function of r, so the place of any
chunk follows from the queue totals alone. Each task therefore starts with the
exact deficits that earlier windows and partitions have left, without
waiting for them, and no document is shuffled:

1. one pass tokenises each document and writes its ids, with the number of
   tokens of its queue that come before it in its partition;
2. totals by partition and queue, summed up, give each partition's start in
   every queue;
3. one pass over the written ids cuts documents into pieces.

Results, also for odd input:

* a null text counts as empty; an empty document is the end token alone;
* a null source is a queue of its own; null or repeated doc_ids and repeated
  rows are packed row by row, as they come;
* documents longer than a sequence are cut into several pieces;
* an empty table gives no pieces;
* any number of sources, each by its name; their totals, a few numbers for
  each source but nothing else, reach the driver and the tasks;
* further columns, of any name, are ignored.

Only the last sequence is shorter than `length`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.llm.bpe import load
from queuelens.llm.common import in_small_batches, slices, small_enough, written

#: Fractional bits of deficits, which are counted in chunks.
BITS = 20
#: More sources than this are served in groups.
FANOUT = 1024
#: Rows of partition starts that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("queue", T.StringType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


@dataclass
class Phase:
    """Rounds during which the same queues have something to send."""

    rounds: int
    sent: np.ndarray  # chunks sent before the phase
    credit: np.ndarray  # deficits at its start, in 2**-BITS chunks
    quantum: np.ndarray  # what a round adds; 0 for empty queues


@dataclass
class Schedule:
    """Where each chunk of each queue goes; made from the queues' totals alone."""

    totals: np.ndarray
    targets: np.ndarray
    chunk: int
    length: int
    phases: list[Phase] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.chunks = -(-self.totals // self.chunk)
        sent, credit = np.zeros_like(self.chunks), np.zeros_like(self.chunks)
        while (left := self.chunks - sent).any():
            share = np.where(left > 0, self.targets, 0.0)
            if not share.sum():  # only queues without a target are left
                share = left.astype(float)
            share = share / share.sum() * (self.length // self.chunk)
            quantum = np.where(left > 0, np.maximum(1, np.round(share * (1 << BITS))), 0).astype(np.int64)
            busy = quantum > 0
            need = (left[busy] << BITS) - credit[busy]
            rounds = max(1, int((-(-need // quantum[busy])).min()))
            self.phases.append(Phase(rounds, sent, credit, quantum))
            held = credit + rounds * quantum
            after = np.minimum(self.chunks, sent + (held >> BITS))
            credit = np.where(after < self.chunks, held - ((after - sent) << BITS), 0)
            sent = after
        #: By queue: chunks sent at the end of each phase.
        self.ends = np.array([p.sent for p in self.phases[1:]] + [self.chunks]).T.reshape(len(self.chunks), max(1, len(self.phases)))
        last = np.flatnonzero(self.totals % self.chunk)
        gaps = self.chunk - self.totals[last] % self.chunk
        places = self.slots(last, self.chunks[last] - 1)
        order = np.argsort(places)
        self.short, self.lost = places[order], np.append(0, np.cumsum(gaps[order]))

    def _sent(self, phase: Phase, r: np.ndarray) -> np.ndarray:
        """Chunks that each queue (columns) has sent after r rounds of a phase (rows)."""
        return np.minimum(self.chunks, phase.sent + ((phase.credit + r[:, None] * phase.quantum) >> BITS))

    def slots(self, queue: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """Place of a queue's chunk among all chunks in the order of sending."""
        out = np.zeros(len(queue), np.int64)
        which = (self.ends[queue] <= chunk[:, None]).sum(axis=1)
        step = max(1, (1 << 22) // max(1, len(self.chunks)))
        for p in np.unique(which):
            phase, rows = self.phases[p], np.flatnonzero(which == p)
            for a in range(0, len(rows), step):
                at = rows[a : a + step]
                q, j = queue[at], chunk[at]
                need = ((j + 1 - phase.sent[q]) << BITS) - phase.credit[q]
                r = np.clip(-(-need // phase.quantum[q]), 1, phase.rounds)
                before, after = self._sent(phase, r - 1), self._sent(phase, r)
                own = np.arange(len(at))
                turn = np.cumsum(after - before, axis=1) - (after - before)
                out[at] = before.sum(axis=1) + turn[own, q] + j - before[own, q]
        return out

    def tokens(self, queue: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """Place of a chunk's first token in the stream of all tokens."""
        slot = self.slots(queue, chunk)
        return slot * self.chunk - self.lost[np.searchsorted(self.short, slot)]

    def segments(self, queue: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, start, length, place) of stretches that lie at `begin` in their queues, cut at chunks; place is in the stream."""
        first, last = begin // self.chunk, (begin + size - 1) // self.chunk
        count = last - first + 1
        item = np.repeat(np.arange(len(begin)), count)
        chunk = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + first[item]
        lo = np.maximum(begin[item], chunk * self.chunk)
        hi = np.minimum(begin[item] + size[item], (chunk + 1) * self.chunk)
        return item, lo - begin[item], hi - lo, self.tokens(queue[item], chunk) + lo - chunk * self.chunk


class Tree:
    """Schedules of groups of queues, and of the queues in each group."""

    def __init__(self, totals: np.ndarray, targets: np.ndarray, chunk: int, length: int):
        self.length = length
        size = len(totals) if len(totals) <= FANOUT else math.isqrt(len(totals) - 1) + 1
        self.group, self.within = np.divmod(np.arange(len(totals)), max(1, size))
        starts = np.arange(0, len(totals), max(1, size))
        self.groups = [Schedule(totals[a : a + size], targets[a : a + size], chunk, length) for a in starts]
        # A single group is the stream itself.
        self.root = Schedule(np.add.reduceat(totals, starts), np.add.reduceat(targets, starts), chunk, length) if len(starts) > 1 else None

    def pieces(self, queue: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """Pieces of documents that lie at `begin` in their queues.

        Returns (document, start, length, sequence, offset) arrays; pieces of
        a document that touch in the same sequence are one.
        """
        found = []
        for g in np.unique(self.group[queue]):
            own = np.flatnonzero(self.group[queue] == g)
            doc, start, length, place = self.groups[g].segments(self.within[queue[own]], begin[own], size[own])
            if self.root is not None:
                item, more, length, place = self.root.segments(np.full(len(place), g), place, length)
                doc, start = doc[item], start[item] + more
            found.append((own[doc], start, length, place))
        doc, start, length, place = (np.concatenate([f[i] for f in found] + [np.zeros(0, np.int64)]) for i in range(4))
        # Cut at the ends of sequences; a chunk reaches over one end at most.
        cut = np.minimum(length, self.length - place % self.length)
        rest = np.flatnonzero(cut < length)
        doc, start, place = (np.concatenate([x, (x + y)[rest]]) for x, y in ((doc, 0), (start, cut), (place, cut)))
        length = np.concatenate([cut, (length - cut)[rest]])
        order = np.lexsort((start, doc))
        doc, start, length, place = doc[order], start[order], length[order], place[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + length[:-1]) | (place[1:] % self.length == 0))[: len(doc)]
        heads = np.flatnonzero(new)
        length = np.add.reduceat(length, heads) if len(heads) else length
        return doc[heads], start[heads], length, place[heads] // self.length, place[heads] % self.length


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """One row per document: its queue, its ids, and the tokens before it.

    `before` counts the tokens of the queue in earlier rows of the partition
    `part`.
    """
    queue = F.col("source").cast("string")
    schema = "part int, queue string, doc_id long, tokens long, before long, ids binary"

    def run(batches):
        coder = load(path)
        kind = "<u2" if max(coder.base, end_id) <= 1 << 16 else "<u4"
        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, offsets = coder.encode_column(rows.column("text"))
                flat = np.insert(ids, offsets[1:], end_id).astype(kind).tobytes()
                tokens = np.diff(offsets) + 1
                ends = np.cumsum(tokens) * np.dtype(kind).itemsize
                before = []
                for q, n in zip(rows.column("queue").to_pylist(), tokens.tolist()):
                    before.append(held.get(q, 0))
                    held[q] = before[-1] + n
                coded = pa.Array.from_buffers(pa.binary(), len(tokens), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(flat)])
                columns = [pa.array([part] * len(tokens), pa.int32()), rows.column("queue"), rows.column("doc_id"), pa.array(tokens), pa.array(before, pa.int64()), coded]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "queue", "doc_id", "tokens", "before", "ids"])
        # Workers live on: what they remember would take memory from later stages.
        coder.forget()
        pa.default_memory_pool().release_unused()

    return in_small_batches(docs.select(queue.alias("queue"), F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, end_id: int, length: int = 2048, chunk: int = 256, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of all documents (schema `PIECES`; `ids` holds little-endian
    unsigned 32-bit ids). `targets` gives the wanted share of tokens by source;
    sources that it lacks come last. See the module's docstring.
    """
    if length % chunk:
        raise ValueError("a sequence must hold a whole number of chunks")
    coded = written(tokenised(docs, path, end_id), "packing-ids")
    parts = written(coded.groupBy("part", "queue").agg(F.sum("tokens").alias("tokens")), "packing-parts")
    totals = sorted(parts.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect(), key=lambda r: (r.queue is not None, r.queue))
    names = [r.queue for r in totals]
    counts = np.array([r.tokens for r in totals], np.int64)
    wanted = counts.astype(float) if targets is None else np.array([targets.get(n, 0.0) for n in names])
    schedule = Tree(counts, wanted, chunk, length)
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("part").alias("p"), F.col("queue").alias("q"), F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("ahead"))
    if small_enough(parts, BROADCAST_ROWS):
        starts = F.broadcast(starts)
    placed = coded.join(starts, (coded.part == starts.p) & coded.queue.eqNullSafe(starts.q)).select("queue", "doc_id", "tokens", (F.col("ahead") + F.col("before")).alias("begin"), "ids")
    number = {n: i for i, n in enumerate(names)}

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "ids"):
                size = rows.column("tokens").to_numpy()
                owner = rows.column("queue").to_pylist()
                queue = np.array([number[q] for q in owner], np.int64)
                doc, start, many, sequence, offset = schedule.pieces(queue, rows.column("begin").to_numpy(), size)
                raw = rows.column("ids").to_pylist()
                wide = [np.frombuffer(x, "<u4" if len(x) == 4 * n else "<u2").astype("<u4").tobytes() for x, n in zip(raw, size)]
                cut = [wide[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), many.tolist())]
                columns = [rows.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(many), pa.array(size[doc]), pa.array(sequence), pa.array(offset), rows.column("queue").take(pa.array(doc)), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=PIECES.names)

    return in_small_batches(placed).mapInArrow(run, PIECES)
