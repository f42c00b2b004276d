"""Exact removal of repeated token windows: what byte-suffix and word-substring deduplication share.

A window is ``length`` consecutive tokens of one document. Its anchor is the least ``gram`` inside it, in an order that
depends on content alone, so equal windows have equal anchors at equal offsets. Neighbouring windows with one anchor form
a cell. The steps are:

1. every document is cut into cells; a cell whose gram stands nowhere else can't repeat and goes;
2. of cells with equal digests the first two are sent on with their tokens, so that two real copies are compared;
3. a resolver compares the tokens right and left of the anchors, and says which windows of a cell repeat;
4. every cell takes over what was found for the two of its digest, and the covered tokens go.

Nothing is removed that the resolver hasn't compared. Grams that a hashed sample shows to be frequent come last in the
anchors' order: a window then hangs on a rarer gram wherever it has one, so that a frequent gram has few different cells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import BYTE_VALUES, SPACE, U64, Rolling, chunks, cut, long, mix, text_buffer, text_key, words_of

OTHER_BASE = 0xD1342543DE82EF95
#: Bytes of one document handled at once.
SEGMENT = 1 << 20
#: Cells that are resolved together, in whole groups of one gram. Beyond MOST cells a group is resolved in parts, whose
#: windows meet by digest.
BUCKET, MOST = 4096, 65536
#: One stretch of STRETCH bytes in so many is looked at for frequent grams; a gram is frequent from FREQUENT finds on.
#: The next three decide which anchors are taken and which task does the work, never what is found.
LOOK, STRETCH, FREQUENT = 64, 1 << 16, 64
SLOT_BITS = 22
#: Tasks over which the cells of one frequent gram are spread.
SALTS = 64


@dataclass(frozen=True)
class Tokens:
    """How texts become tokens: bytes, or words parted by ASCII white space."""

    length: int
    gram: int
    words: bool

    def read(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token values, first and end bytes, and where each row's tokens begin."""
        if self.words:
            return words_of(raw, offsets)
        at = np.arange(len(raw) + 1)
        return BYTE_VALUES[raw], at[:-1], at[1:], offsets

    def stop(self, raw: np.ndarray, at: int) -> int:
        """The first place from ``at`` on where a text can be parted without parting a token."""
        while self.words and at < len(raw):
            blank = np.flatnonzero(SPACE[raw[at : at + SEGMENT]])
            if len(blank):
                return at + int(blank[0])
            at += SEGMENT
        return min(at, len(raw))

    def pieces(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(values, first bytes, end bytes, where rows begin, number of the first token); each window is in one piece."""
        if len(raw) <= SEGMENT or len(offsets) > 2:
            yield *self.read(raw, offsets), 0
            return
        held, number, at = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)), 0, 0
        while at < len(raw):
            end = self.stop(raw, at + SEGMENT)
            value, a, b, _ = self.read(raw[at:end], np.array([0, end - at]))
            piece = tuple(np.concatenate(x) for x in zip(held, (value, a + at, b + at)))
            yield *piece, np.array([0, len(piece[0])]), number
            over = max(0, len(piece[0]) - self.length + 1)
            held, number, at = tuple(x[over:] for x in piece), number + over, end


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices first[i] .. first[i] + count[i] - 1 of every i, one after the other, and their i."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner], owner


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> U64(64 - SLOT_BITS)).astype(np.int64)


def cells_of(tok: np.ndarray, first: np.ndarray, t: Tokens, often: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor, gram hash, cell hash) of every cell."""
    w = t.length - t.gram + 1
    start, row = spread(first[:-1], np.maximum(np.diff(first) - t.length + 1, 0))
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(U64), none.view(U64)
    at = np.arange(len(tok) - t.gram + 1)
    grams = Rolling(tok).of(at, at + t.gram)
    least = (grams >> U64(1)) & U64(0x7FFFFFFF00000000) | at.astype(U64)
    if often is not None:
        least |= often[slots(grams)].astype(U64) << U64(63)
    reach = 1
    while reach < w:  # minimum over ever longer stretches
        step = min(reach, w - reach)
        least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    anchor = (least[start] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    lo, hi = start[head], start[tail]
    cell = mix(Rolling(tok, OTHER_BASE).of(lo, hi + t.length) + (hi - lo).astype(U64))
    return row[head], lo, hi, anchor[head], grams[anchor[head]], cell


def _sampled(t: Tokens):
    """(slot, n): grams of sampled stretches, counted by the leading bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            raw, offsets = text_buffer(batch.column(1))
            key = batch.column(0).to_numpy().view(U64)
            for r in range(batch.num_rows):
                a, b = offsets[r], offsets[r + 1]
                lots = -(-int(b - a) // STRETCH)
                hit = mix(key[r] + np.arange(lots, dtype=U64) * U64(0x9E3779B97F4A7C15)) % U64(LOOK) == 0
                for k in np.flatnonzero(hit):
                    part = raw[a + k * STRETCH : min(b, a + (k + 1) * STRETCH + t.length)]
                    tok = t.read(part, np.array([0, len(part)]))[0]
                    if len(tok) < t.length:
                        continue
                    at = np.arange(len(tok) - t.gram + 1)
                    slot, n = np.unique(slots(Rolling(tok).of(at, at + t.gram)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], names=["slot", "n"])

    return run


def frequent(source: DataFrame, t: Tokens) -> np.ndarray | None:
    """A fixed-size bit map of the slots of frequent grams, None without any. It bounds no search: any map gives the same result."""
    some = source.select(F.xxhash64("doc_id", "th").alias("key"), "text").filter(F.octet_length("text") >= t.length)
    seen = cut(some.mapInArrow(_sampled(t), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")), "slots")
    mean = (seen.agg(F.sum("n")).first()[0] or 0) / (1 << SLOT_BITS)
    often = seen.filter(F.col("n") >= max(FREQUENT, 8 * mean)).select("slot").toArrow().column(0).to_numpy()  # at most 2 ** SLOT_BITS / 8 rows
    if not len(often):
        return None
    bits = np.zeros(1 << SLOT_BITS, bool)
    bits[often] = True
    return bits


FOUND = "gram long, cell long, salt int, doc_id long, th long, lo long, n int, off int, at long, size int"


def _found(t: Tokens, packed: bytes | None):
    """Every cell, by gram and digest, with its windows lo..lo+n, its anchor's place in it, and its bytes at..at+size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = None if packed is None else np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in chunks(batches):
            doc, th = batch.column(0), batch.column(1)
            raw, offsets = text_buffer(batch.column(2))
            for tok, begin, end, first, number in t.pieces(raw, offsets):
                row, lo, hi, anchor, gram, cell = cells_of(tok, first, t, often)
                if not len(row):
                    continue
                at, size = begin[lo] - offsets[row], end[hi + t.length - 1] - begin[lo]
                salt = np.full(len(row), -1, np.int32)
                if often is not None:
                    hot = often[slots(gram)]
                    name = pc.fill_null(doc, 0).to_numpy().astype(U64) + th.to_numpy().view(U64)
                    salt[hot] = (mix(name[row[hot]] + lo[hot].astype(U64)) % U64(SALTS)).astype(np.int32)
                rows = pa.array(row)
                numbers = [pa.array(x.astype(np.int32)) for x in (hi - lo, anchor - lo)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(long(gram)), pa.array(long(cell)), pa.array(salt), doc.take(rows), th.take(rows), pa.array(lo - first[row] + number), *numbers, pa.array(at), pa.array(size.astype(np.int32))],
                    names=["gram", "cell", "salt", "doc_id", "th", "lo", "n", "off", "at", "size"],
                )

    return run


def _lists(column: pa.Array, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row offsets and flat fields of a list<struct> column; null is an empty list."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(counts)]), [pc.struct_field(flat, f).to_numpy(zero_copy_only=False) for f in fields]


def binaries(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The stretches of ``raw`` as a binary column."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[spread(start, size)[0]]))])


CONTEXTS = "lead binary, gram long, cell long, n int, off int, hot boolean, content binary"


def _contexts(t: Tokens):
    """The bytes of every cell that was asked for; ``lead`` is its anchor's gram where tokens are bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            raw, offsets = text_buffer(batch.column(0))
            ends, (at, size, off, n, gram, cell, hot) = _lists(batch.column(1), ("at", "size", "off", "n", "gram", "cell", "hot"))
            at = at + np.repeat(offsets[:-1], np.diff(ends))
            done = 0
            while done < len(at):  # about SEGMENT bytes at once
                some = slice(done, done + max(1, int(np.searchsorted(np.cumsum(size[done : done + SEGMENT], dtype=np.int64), SEGMENT))))
                done = some.stop
                lead = pa.nulls(len(at[some]), pa.binary()) if t.words else binaries(raw, at[some] + off[some], np.full(len(at[some]), t.gram))
                yield pa.RecordBatch.from_arrays(
                    [lead, pa.array(gram[some]), pa.array(cell[some]), pa.array(n[some].astype(np.int32)), pa.array(off[some].astype(np.int32)), pa.array(hot[some].astype(bool)), binaries(raw, at[some], size[some].astype(np.int64))],
                    names=["lead", "gram", "cell", "n", "off", "hot", "content"],
                )

    return run


def groups(batches: Iterator[pa.RecordBatch], key: Callable[[pa.RecordBatch], np.ndarray], bucket: int, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows of about ``bucket`` in whole groups of equal neighbouring keys. A group beyond ``most`` rows comes in parts, marked True.

    Where a batch ends inside a group, its last key is compared with the next batch's first one, so an edge never parts a group.
    """
    held, tail, last, split = [], [], None, False
    size = lambda parts: sum(b.num_rows for b in parts)
    for batch in batches:
        if not batch.num_rows:
            continue
        k = key(batch)
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), batch.num_rows]
        first = 0
        if last is not None and last == k[0]:
            tail.append(batch.slice(0, edges[1]))
            if size(tail) > most:
                yield pa.Table.from_batches(tail), True
                tail, split = [], True
            first = 1
            if len(edges) == 2:
                continue
        if split and tail:
            yield pa.Table.from_batches(tail), True
        elif not split:
            held += tail
        held.append(batch.slice(edges[first], edges[-2] - edges[first]))
        tail, last, split = [batch.slice(edges[-2])], k[-1], False
        if size(held) >= bucket:
            yield pa.Table.from_batches(held), False
            held = []
    if split and tail:
        yield pa.Table.from_batches(tail), True
        tail = []
    if size(held + tail):
        yield pa.Table.from_batches(held + tail), False


def windows(classes_right: Callable[[int], np.ndarray], classes_left: Callable[[int], np.ndarray], off: np.ndarray, right: np.ndarray, t: Tokens) -> tuple[np.ndarray, ...]:
    """(cell, window in it, repeats, first of its kind): a window repeats if another cell agrees with it on both sides of the anchor."""
    cell, start, dup, lead = ([np.zeros(0, d)] for d in (np.int64, np.int64, bool, bool))
    for left in range(t.length - t.gram + 1):
        rows = np.flatnonzero((off >= left) & (right >= t.length - left))
        if not len(rows):
            continue
        pair = classes_right(t.length - left)[rows] * (len(off) + 1) + classes_left(left)[rows]
        _, index, inverse, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        one = np.zeros(len(rows), bool)
        one[index] = True
        cell.append(rows)
        start.append(off[rows] - left)
        dup.append(count[inverse] > 1)
        lead.append(one)
    return tuple(np.concatenate(x) for x in (cell, start, dup, lead))


RESOLVED = "part boolean, d1 long, d2 long, gram long, cell long, hot boolean, a int, b int, dup boolean"


def _resolved(t: Tokens, resolve: Callable, key: Callable, bucket: int, most: int):
    """Intervals a..b of repeated windows of every cell; of a group in parts also every kind of window, by digest."""

    def rows(part, d1, d2, gram, cell, hot, a, b, dup) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), part)), pa.array(d1), pa.array(d2), pa.array(gram), pa.array(cell), pa.array(hot), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(dup)],
            names=["part", "d1", "d2", "gram", "cell", "hot", "a", "b", "dup"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, part in groups(batches, key, bucket, most):
            table = table.combine_chunks()
            gram, cell, off, hot = (table.column(c).to_numpy() for c in ("gram", "cell", "off", "hot"))
            column = table.column("content").combine_chunks()
            raw, offsets = text_buffer(column.cast(pa.large_binary()))
            own, start, dup, lead = resolve(raw, offsets, off.astype(np.int64), t)
            first = np.ones(len(cell), bool)
            first[1:] = (cell[1:] != cell[:-1]) | (gram[1:] != gram[:-1])
            hit = np.flatnonzero(dup & first[own])
            hit = hit[np.lexsort((start[hit], own[hit]))]
            if len(hit):
                c, s = own[hit], start[hit]
                fresh = np.ones(len(c), bool)
                fresh[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1] + 1)
                a = np.flatnonzero(fresh)
                b = np.append(a[1:], len(c)) - 1
                none = np.zeros(len(a), np.int64)
                yield rows(False, none, none, gram[c[a]], cell[c[a]], hot[c[a]], s[a], s[b], np.ones(len(a), bool))
            if part:
                tok, _, _, begin = t.read(raw, offsets)
                for some in np.array_split(np.flatnonzero(lead), max(1, int(lead.sum()) // 65536)):
                    c, s = own[some], start[some]
                    at = begin[c] + s
                    yield rows(True, long(Rolling(tok).of(at, at + t.length)), long(Rolling(tok, OTHER_BASE).of(at, at + t.length)), gram[c], cell[c], hot[c], s, s, dup[some])

    return run


def _merged(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Runs of tokens that windows lo..hi cover, as first and end tokens."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + length) if len(lo) else hi
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > end[:-1]
    first = np.flatnonzero(new)
    return lo[first].tolist(), end[np.append(first[1:], len(lo)) - 1].tolist() if len(lo) else []


def _kept_bytes(text: memoryview, start: list[int], end: list[int]) -> Iterator[memoryview]:
    for a, b in zip([0, *end], [*start, len(text)]):
        yield text[a:b]


def _kept_words(raw: np.ndarray, t: Tokens, start: list[int], end: list[int], total: list[int]) -> Iterator[bytes]:
    """The words outside the runs, joined by blanks, a piece of the text at a time; their number in all is added to ``total``."""
    at, number, k, any_yet = 0, 0, 0, False
    while at < len(raw):
        stop = t.stop(raw, at + SEGMENT)
        words = raw[at:stop].tobytes().split()
        kept, place = [], number
        while k < len(start) and start[k] < number + len(words):
            kept += words[max(place, number) - number : max(start[k] - number, 0)]
            place = end[k]
            if place > number + len(words):
                break  # the run goes on in the next piece
            k += 1
        kept += words[max(place - number, 0) :]
        number += len(words)
        if kept:
            yield (b" " if any_yet else b"") + b" ".join(kept)
            any_yet = True
        at = stop
    total.append(number)


OUT = "doc_id long, n_tokens long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(t: Tokens, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            raw, offsets = text_buffer(batch.column(1))
            ends, (lo, hi) = _lists(batch.column(2), ("lo", "hi"))
            out: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                row = raw[offsets[i] : offsets[i + 1]]
                start, end = _merged(lo[ends[i] : ends[i + 1]], hi[ends[i] : ends[i + 1]], t.length)
                total: list[int] = []
                sha, kept = hashlib.sha256(), []
                for part in _kept_words(row, t, start, end, total) if t.words else _kept_bytes(memoryview(row), start, end):
                    sha.update(part)
                    if texts:
                        kept.append(bytes(part))
                for column, value in zip(out, (total[0] if t.words else len(row), sum(end) - sum(start), len(start), sha.hexdigest(), b"".join(kept))):
                    column.append(value)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(np.diff(offsets)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())]
            names = ["doc_id", "n_tokens", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(out[4], pa.binary())] * texts, names=names + ["kept"] * texts)

    return run


def first_two(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``rep`` (one of the first two of its cell) and ``alone`` (no other row has its keys), by one sort."""
    w = Window.partitionBy(*keys).orderBy("cell")
    near = rows.select("*", F.lag("cell").over(w).alias("before"), F.lag("cell", 2).over(w).alias("before2"), F.lead("cell").over(w).alias("after"))
    rep = F.coalesce(F.col("before2") != F.col("cell"), F.lit(True))
    return near.withColumns({"rep": rep, "alone": F.col("before").isNull() & F.col("after").isNull()}).drop("before", "before2", "after")


def remove_repeats(docs: DataFrame, t: Tokens, resolve: Callable, key: Callable, deal: Callable[[DataFrame], DataFrame], *, bucket: int = BUCKET, most: int = MOST, texts: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, n_bytes, n_removed, n_spans, kept_sha256`` (and the ``kept`` bytes).

    ``deal`` brings cells of one gram together and orders them, ``key`` tells the grams of a batch, and ``resolve`` gives
    the windows of a bucket's cells. A token goes if a window over it starts anywhere else too; windows are judged on the
    input. ``n_spans`` counts maximal removed runs. Null texts are empty; documents shorter than a window keep
    everything; equal rows count as copies of each other; rows that share a doc_id or have none are told apart by a
    64-bit hash of their texts. Long texts are read in pieces of SEGMENT bytes. Other columns are ignored; an empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), text.alias("text"))
    often = frequent(source, t)
    found = source.mapInArrow(_found(t, None if often is None else np.packbits(often).tobytes()), FOUND)
    cells = cut(first_two(found, "gram", "salt").filter("salt >= 0 or not alone").drop("alone"), "cells")
    reps = cells.filter("rep")
    if often is not None:  # the two of a frequent gram's cell are found among those of its salts
        reps = reps.filter("salt < 0").unionByName(first_two(reps.filter("salt >= 0").drop("rep"), "gram").filter("rep and not alone").drop("alone"))
    asked = reps.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_list(F.struct("at", "size", "off", "n", "gram", "cell", (F.col("salt") >= 0).alias("hot"))).alias("cells"))

    def with_text(other: DataFrame, how: str) -> DataFrame:
        return source.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), how)

    contexts = with_text(asked, "inner").select("text", "cells").mapInArrow(_contexts(t), CONTEXTS)
    resolved = cut(deal(contexts).mapInArrow(_resolved(t, resolve, key, bucket, most), RESOLVED), "resolved")
    verdict = resolved.filter("not part")
    parts = resolved.filter("part")
    if not parts.isEmpty():
        met = parts.groupBy("d1", "d2").agg(F.collect_list(F.struct("gram", "cell", "hot", "a", "b", "dup")).alias("rows"))
        verdict = verdict.select("gram", "cell", "hot", "a", "b").unionByName(met.filter("size(rows) > 1").select(F.inline("rows")).filter("not dup").drop("dup"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    verdict = verdict.select("gram", "cell", F.explode(salts).alias("salt"), "a", "b")
    covered = cells.select("gram", "cell", "salt", "doc_id", "th", "lo").join(verdict, ["gram", "cell", "salt"])
    spans = covered.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_list(F.struct((F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"))).alias("spans"))
    return with_text(spans, "left").select("doc_id", "text", "spans").mapInArrow(_removed(t, texts), OUT + ", kept binary" * texts)
