"""Removal of repeated byte strings, by anchors and external induced sorting.

A 100-byte string occurs again exactly where an equal one starts earlier. Every such string (a
window) is owned by the smallest hash among its 32-byte parts, its anchor, so equal windows own
equal anchors at equal offsets, and about 35 windows share one. The bytes under the windows of an
anchor are its context.

1. Each task finds the anchors of its documents, sends one record for a context it has several times
   and settles the copies itself, so a passage that a third of the corpus holds costs each task
   one record. Records meet by anchor. A context that some other record equals is settled: only the
   earliest keeps its windows. An anchor with one context has no other occurrence and is settled
   too. What remains are anchors with different contexts: the ends of copied passages.
2. The bytes of those contexts are dealt into shards by anchor, and each shard is suffix-sorted by
   induction, with queues that spill to disk. Neighbours in that order that share 100 bytes are
   equal windows; all but the earliest are removed. An anchor with very many contexts is dealt
   by window instead, so no shard holds more than a bound of one anchor.
3. The removed windows are joined to the documents and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import maybe_broadcast, small_batches, stored, table
from docloom.llm.induced import common_prefix, suffix_array
from docloom.llm.tokens import CHUNK, chunks, mix, powers, text_bytes

WINDOW, PART = 100, 32
#: Anchors that a task combines before it sends them; bytes of records and of contexts that make a shard.
COMBINED, SHARD_RECORDS, SHARD_BYTES = 1 << 19, 4 << 20, 1 << 20
#: Contexts of one anchor beyond which they are dealt by window.
HOT_ANCHOR = 4096
#: Record: anchor and context hash, document, start of the context in it and its number of windows (0: the anchor has many contexts).
RECORD = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("same", "<i8"), ("start", "<u4"), ("n", "<u4")])
#: Mark: a run of windows of a document, and the anchor if their fate is open (0: they go).
MARK = np.dtype([("start", "<u4"), ("n", "<u4"), ("anchor", "<u8")])


#: Bytes of each field that are sent: buckets and equal contexts need no more of the hashes.
SENT_BYTES = {"anchor": 5, "context": 6, "doc": 8, "same": 8, "start": 4, "n": 1}


def pack(r: np.ndarray) -> bytes:
    """Records byte by byte, each byte of a field together and those that are all zero left out, so that ids of few bytes cost no more."""
    planes = np.concatenate([np.ascontiguousarray(r[f]).view(np.uint8).reshape(len(r), -1)[:, :k].T for f, k in SENT_BYTES.items()])
    used = planes.any(axis=1)
    return len(r).to_bytes(4, "little") + np.packbits(used).tobytes() + planes[used].tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, total = int.from_bytes(data[:4], "little"), sum(SENT_BYTES.values())
    used = np.unpackbits(np.frombuffer(data, np.uint8, (total + 7) // 8, 4))[:total].astype(bool)
    planes = np.zeros((total, n), np.uint8)
    planes[used] = np.frombuffer(data, np.uint8, offset=4 + (total + 7) // 8).reshape(-1, n)
    out, at = np.zeros(n, RECORD), 0
    for f, k in SENT_BYTES.items():
        whole = np.zeros((n, RECORD[f].itemsize), np.uint8)
        whole[:, :k] = planes[at : at + k].T
        out[f] = whole.view(RECORD[f])[:, 0]
        at += k
    return out


def anchors_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of rows of bytes: row, anchor hash, context hash, start (in data) and number of windows."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    n, span = len(data), WINDOW - PART + 1
    if n < WINDOW:
        return none
    up, down = powers(n + 1)
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)]
    parts = mix((total[PART:] - total[:-PART]) * down[: n - PART + 1])
    # the order of anchors is by hash and then by place, which windows of equal bytes share
    low = parts & ~np.uint64(0xFFFFFF) | np.arange(len(parts), dtype=np.uint64) & np.uint64(0xFFFFFF)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - WINDOW + 1], low[span - width : span - width + n - WINDOW + 1])
    place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    start = np.arange(len(place))
    place += start >> 24 << 24
    place += np.where(place < start, 1 << 24, 0)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(start)]
    good = start + WINDOW <= at[row + 1]
    start, place, row = start[good], place[good], row[good]
    if not len(start):
        return none
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    count = np.diff(np.r_[first, len(start)])
    start, place, row = start[first], place[first], row[first]
    end = start + count - 1 + WINDOW
    context = mix((total[end] - total[start]) * down[start] + (count * WINDOW + place - start).astype(np.uint64))
    return row, parts[place], context, start, count


def leads(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by keys and then order: the permutation, the group of each, and whether it starts where its group's first does not, so later."""
    by = np.lexsort((*order[::-1], *keys[::-1]))
    new = np.zeros(len(by), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[by[1:]] != k[by[:-1]]
    group = np.cumsum(new) - 1
    head = by[np.flatnonzero(new)][group] if len(by) else by
    later = np.zeros(len(by), bool)
    for o in order:
        later |= o[by] != o[head]
    return by, group, later


def marked(doc: np.ndarray, same: np.ndarray, marks: np.ndarray) -> tuple[list, list, list]:
    """Marks gathered by document: doc, same and the packed marks."""
    by = np.lexsort((marks["start"], same, doc))
    doc, same, marks = doc[by], same[by], marks[by]
    cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (same[1:] != same[:-1])) + 1
    heads = np.r_[0, cuts] if len(doc) else cuts
    return doc[heads].tolist(), same[heads].tolist(), [m.tobytes() for m in np.split(marks, cuts)] if len(doc) else []


SENT = "bucket int, records binary, doc long, same long, marks binary"


def sent(buckets: list, records: list, doc: list, same: list, marks: list) -> pa.RecordBatch:
    a, b = len(buckets), len(doc)
    return pa.record_batch(
        [pa.array([*buckets, *[d % 1024 for d in doc]], pa.int32()), pa.array([*records, *[None] * b], pa.binary()), pa.array([*[None] * a, *doc], pa.int64()), pa.array([*[None] * a, *same], pa.int64()), pa.array([*[None] * a, *marks], pa.binary())],
        names=["bucket", "records", "doc", "same", "marks"],
    )


def combine(held: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """What a task sends of its records: the first of each context, and marks of the others."""
    r = np.concatenate(held)
    by, group, later = leads((r["anchor"], r["context"]), (r["doc"], r["same"], r["start"]))
    r = r[by]
    first = np.r_[True, group[1:] != group[:-1]]
    gone = r[later & ~first]
    own = r[first]
    alike = own["anchor"][1:] == own["anchor"][:-1]
    many = np.r_[False, alike] | np.r_[alike, False]
    open_ = own[many]
    token = own[many & np.r_[True, ~alike]].copy()
    token["n"] = 0
    records = np.concatenate([own[~many], token])
    place = ((records["anchor"] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order])) + 1
    parts = np.split(records[order], cuts) if len(records) else []
    ids = place[order][np.r_[0, cuts]].tolist() if len(records) else []
    marks = np.zeros(len(gone) + len(open_), MARK)
    for f in ("start", "n"):
        marks[f] = np.r_[gone[f], open_[f]]
    marks["anchor"][len(gone) :] = open_["anchor"] & np.uint64((1 << 40) - 1)
    return sent(ids, [pack(p) for p in parts], *marked(np.r_[gone["doc"], open_["doc"]], np.r_[gone["same"], open_["same"]], marks))


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows, with the bytes left out before them, their bytes and offsets. A long row comes in parts that overlap by a window less one byte: a context that is cut there is not lost but only left open."""
    for i, j in chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        if j == i + 1 and len(part) > 2 * CHUNK:
            for a in range(0, len(part), CHUNK):
                own = part[a : a + CHUNK + WINDOW - 1]
                yield i, j, a, own, np.array([0, len(own)])
        else:
            yield i, j, 0, part, offsets[i : j + 1] - offsets[i]


def find_anchors(buckets: int):
    """Batches of (doc, same, text) to SENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            doc, same = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = text_bytes(batch.column(2))
            for i, j, skip, part, at in pieces(data, offsets):
                row, anchor, context, start, n = anchors_of(part, at)
                r = np.zeros(len(row), RECORD)
                r["anchor"], r["context"], r["doc"], r["same"], r["start"], r["n"] = anchor | np.uint64(1), context, doc[i + row], same[i + row], start - at[row] + skip, n
                held.append(r)
                size += len(r)
                if size >= COMBINED:
                    yield combine(held, buckets)
                    held, size = [], 0
        if size:
            yield combine(held, buckets)

    return run


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SENT in order of bucket to (doc, same, marks): contexts that go, and those that remain open."""

    def out(parts: list[bytes]) -> tuple[list, list, list]:
        r = np.concatenate([unpack(p) for p in parts])
        many = np.unique(r["anchor"][r["n"] == 0])
        r = r[r["n"] > 0]
        by, group, later = leads((r["anchor"], r["context"]), (r["doc"], r["same"], r["start"]))
        r = r[by]
        first = np.r_[True, group[1:] != group[:-1]] if len(r) else np.zeros(0, bool)
        own = r[first]
        alike = own["anchor"][1:] == own["anchor"][:-1]
        left = np.isin(own["anchor"], many)
        if len(own):
            left |= np.r_[False, alike] | np.r_[alike, False]
        gone, open_ = r[later & ~first], own[left]
        marks = np.zeros(len(gone) + len(open_), MARK)
        for f in ("start", "n"):
            marks[f] = np.r_[gone[f], open_[f]]
        marks["anchor"][len(gone) :] = open_["anchor"]
        return marked(np.r_[gone["doc"], open_["doc"]], np.r_[gone["same"], open_["same"]], marks)

    bucket, parts = None, []
    for batch in batches:
        doc, same, marks = [], [], []
        for b, records, d, s, m in zip(*(batch.column(k) for k in range(5)), strict=True):
            if not m.is_valid:
                if b != bucket and parts:
                    for to, new in zip((doc, same, marks), out(parts), strict=True):
                        to += new
                    parts = []
                bucket = b
                parts.append(records.as_py())
            else:
                doc.append(d.as_py())
                same.append(s.as_py())
                marks.append(m.as_py())
        yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(same, pa.int64()), pa.array(marks, pa.binary())], names=["doc", "same", "marks"])
    if parts:
        doc, same, marks = out(parts)
        yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(same, pa.int64()), pa.array(marks, pa.binary())], names=["doc", "same", "marks"])


def cut(text: bytes, start: np.ndarray, n: np.ndarray) -> tuple[int, int, str, bytes, list[tuple[int, int]]]:
    """Bytes removed, removed runs, digest of the rest, the rest, and the runs, of runs of n windows from start."""
    order = np.argsort(start, kind="stable")
    a, b = start[order].astype(np.int64), start[order].astype(np.int64) + n[order] - 1 + WINDOW
    runs: list[tuple[int, int]] = []
    if len(a):
        reach = np.maximum.accumulate(b)
        new = np.r_[True, a[1:] > reach[:-1]]
        heads = np.flatnonzero(new)
        runs = list(zip(a[heads].tolist(), reach[np.r_[heads[1:] - 1, len(a) - 1]].tolist(), strict=True))
    rest, at = [], 0
    for x, y in runs:
        rest.append(text[at:x])
        at = y
    rest.append(text[at:])
    kept = b"".join(rest)
    return len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, runs


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def gathered(column, i: int) -> np.ndarray:
    parts = column[i].as_py()
    return np.frombuffer(b"".join(parts) if isinstance(parts, list) else parts or b"", MARK)


#: Bytes of contexts that leave a worker together.
OPENED_BYTES = 4 << 20
OPENED = RESULT + ", doc long, same long, anchor long, start long, context binary"


def open_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, doc, same, text, marks) to RESULT, as if no open context were repeated, and to the open contexts as (doc, same, anchor, start, context).

    Contexts leave by OPENED_BYTES, within documents too, and as whole columns: a worker holds no object for each.
    """
    for batch in batches:
        rows, held, size = [], [], 0
        for i, (doc_id, doc, same, text) in enumerate(zip(*(batch.column(k) for k in range(4)), strict=True)):
            text = np.frombuffer(text.as_buffer(), np.uint8)
            marks = gathered(batch.column(4), i)
            gone, open_ = marks[marks["anchor"] == 0], marks[marks["anchor"] != 0]
            removed, spans, sha, _, runs = cut(text.tobytes(), gone["start"], gone["n"])
            rows.append((doc_id.as_py(), len(text), removed, spans, sha, [{"start": a, "end": b} for a, b in runs], doc.as_py(), same.as_py()))
            ends = np.cumsum(open_["n"].astype(np.int64) - 1 + WINDOW)
            at = 0
            while at < len(open_):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + OPENED_BYTES - size, "right")))
                part = open_[at:upto]
                held.append((np.full(len(part), doc.as_py()), np.full(len(part), same.as_py()), part["anchor"].view(np.int64), part["start"].astype(np.int64), *sliced(text, part)))
                size += int(ends[upto - 1] - (ends[at - 1] if at else 0))
                at = upto
                if size >= OPENED_BYTES:
                    yield opened([], held)
                    held, size = [], 0
        yield opened(rows, held)


def sliced(text: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the marks' contexts, end to end, and their lengths."""
    length = marks["n"].astype(np.int64) - 1 + WINDOW
    before = np.cumsum(length) - length
    return text[np.repeat(marks["start"].astype(np.int64) - before, length) + np.arange(length.sum())], length


def opened(rows: list[tuple], held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string(), _SPANS] + [pa.int64()] * 2
    columns = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) if rows else [()] * len(kinds), kinds, strict=True)]
    doc, same, anchor, start, data, length = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint8), np.zeros(0, np.int64))
    offsets = np.r_[0, np.cumsum(length)].astype(np.int32)
    contexts = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    left = [pa.concat_arrays([c, pa.nulls(len(doc), c.type)]) for c in columns[:6]]
    both = [pa.concat_arrays([c, pa.array(x, pa.int64())]) for c, x in zip(columns[6:], (doc, same), strict=True)]
    right = [pa.concat_arrays([pa.nulls(len(rows), x.type), x]) for x in (pa.array(anchor, pa.int64()), pa.array(start, pa.int64()), contexts)]
    return pa.record_batch([*left, *both, *right], names=[x.split()[0] for x in OPENED.split(", ")])


def repeated_windows(doc: np.ndarray, same: np.ndarray, start: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts (document, same, start, bytes): document, same and start of each window of which an equal one starts earlier."""
    size = np.diff(offsets)
    of = np.repeat(np.arange(len(size)), size)
    text = np.ones(len(data) + len(size) + 1, np.uint8)  # a byte that no text has ends each context, a smaller one all
    text[np.arange(len(data)) + of] = data
    text[-1] = 0
    of = np.r_[np.repeat(np.arange(len(size)), size + 1), len(size) - 1]
    place = np.arange(len(text)) - (offsets[:-1] + np.arange(len(size)))[of]
    order = suffix_array(text, WINDOW)
    order = order[place[order] + WINDOW <= size[of[order]]]
    equal = common_prefix(text, order[1:], order[:-1], WINDOW)
    group = np.cumsum(np.r_[True, ~equal])
    alone = np.r_[True, ~equal] & np.r_[~equal, True]
    order, group = order[~alone], group[~alone]
    d, s, w = doc[of[order]], same[of[order]], start[of[order]] + place[order]
    by, _, later = leads((group,), (d, s, w))
    by = by[later]
    return d[by], s[by], w[by]


def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, doc, same, start, context) in order of shard to (doc, same, marks)."""

    def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        doc, same, start = (whole.column(k).to_numpy() for k in (1, 2, 3))
        d, s, w = repeated_windows(doc, same, start, *text_bytes(whole.column(4)))
        marks = np.zeros(len(d), MARK)
        marks["start"], marks["n"] = w, 1
        columns = marked(d, s, marks)
        return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["doc", "same", "marks"])

    shard, parts = None, []
    for batch in batches:
        shards = batch.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if shards[a] != shard and parts:
                yield out(parts)
                parts = []
            shard = shards[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield out(parts)


def close_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, marks, more) to RESULT."""
    for batch in batches:
        rows = []
        for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            text = text.as_py()
            gone = np.concatenate([gathered(batch.column(2), i), gathered(batch.column(3), i)])
            gone = gone[gone["anchor"] == 0]
            removed, spans, sha, _, runs = cut(text, gone["start"], gone["n"])
            rows.append((doc_id, len(text), removed, spans, sha, [{"start": a, "end": b} for a, b in runs]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string(), _SPANS], strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def deduplicate(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of documents(doc_id, text).

    Removed is each byte of a 100-byte string that also starts earlier: in a smaller doc_id, or
    earlier in the same document, judged on the texts as they came. spans are the maximal removed
    runs. A null text is empty; a null doc_id comes before all others; rows that repeat both doc_id
    and text count as one document and are answered each, rows that repeat a doc_id alone are
    ordered by a hash of their text; other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    twice = stored(rows.groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").select("doc", F.lit(True).alias("twice")), "twice")
    rows = rows.join(maybe_broadcast(twice, 16), "doc", "left")
    rows = rows.select("doc_id", "doc", F.when(F.col("twice"), F.xxhash64("text")).otherwise(0).alias("same"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_RECORDS)
    found = rows.select("doc", "same", "text").mapInArrow(find_anchors(buckets), SENT)
    marks = found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(settle, "doc long, same long, marks binary")
    marks = stored(marks.groupBy("doc", "same").agg(F.collect_list("marks").alias("marks")), "marks")

    def beside(side: DataFrame, kind: str) -> DataFrame:
        """Rows whose document is in side, or with left_anti the others; where side fits, no text is shuffled for this."""
        return rows.join(maybe_broadcast(side.select("doc", "same"), 32), ["doc", "same"], kind)

    first = beside(marks, "left_semi").join(marks, ["doc", "same"]).select("doc_id", "doc", "same", "text", "marks")
    first = first.unionByName(beside(marks, "left_anti").withColumn("marks", F.lit(None).cast("array<binary>")).select("doc_id", "doc", "same", "text", "marks"))
    first = stored(first.mapInArrow(open_documents, OPENED), "opened")

    contexts = first.where("anchor IS NOT NULL").select("anchor", "doc", "same", "start", "context")
    hot = stored(contexts.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ANCHOR).select("anchor"), "hot")
    bytes_ = F.octet_length("context")
    dealt = F.when(F.col("hot"), (bytes_ - WINDOW + 1) * WINDOW).otherwise(bytes_)  # a hot anchor's windows come one by one
    total = contexts.join(maybe_broadcast(hot, 16).withColumn("hot", F.lit(True)), "anchor", "left").agg(F.sum(dealt.cast("long"))).first()[0] or 0
    shards = max(1, total // SHARD_BYTES)
    shard = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shards)).alias("shard")
    cold = contexts.join(hot, "anchor", "left_anti").select(shard("anchor"), "doc", "same", "start", "context")
    each = contexts.join(hot, "anchor", "left_semi").select("doc", "same", "start", "context", F.explode(F.sequence(F.lit(0), F.octet_length("context") - WINDOW)).alias("i"))
    each = each.select("doc", "same", (F.col("start") + F.col("i")).alias("start"), F.substring("context", F.col("i") + 1, F.lit(WINDOW)).alias("context"))
    cold = cold.union(each.select(shard("context"), "doc", "same", "start", "context"))
    more = cold.repartition("shard").sortWithinPartitions("shard").mapInArrow(sort_shards, "doc long, same long, marks binary")
    more = stored(more.groupBy("doc", "same").agg(F.collect_list("marks").alias("more")), "more")

    names = [x.split()[0] for x in RESULT.split(", ")]
    done = first.where("anchor IS NULL").join(maybe_broadcast(more.select("doc", "same"), 32), ["doc", "same"], "left_anti").select(*names)
    again = beside(more, "left_semi").join(more, ["doc", "same"]).join(marks, ["doc", "same"], "left")
    return done.union(again.select("doc_id", "text", "marks", "more").mapInArrow(close_documents, RESULT))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("spans")


#: doc_ids are taken as unique.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * WINDOW}) AS w FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {WINDOW - 1})) AS i FROM d WHERE length(h) >= {2 * WINDOW})),
starts AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
gaps AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {WINDOW}, true) AS new FROM starts),
runs AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gaps),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS b FROM runs GROUP BY doc_id, run),
parts AS (
  SELECT s.doc_id, a AS pos, substr(h, 2 * lag(b, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY a) + 1, 2 * (a - lag(b, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY a))) AS part FROM spans s JOIN d USING (doc_id)
  UNION ALL SELECT d.doc_id, length(h) AS pos, substr(h, 2 * coalesce(e.b, 0) + 1) AS part FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM spans GROUP BY 1) e USING (doc_id)),
kept AS (SELECT doc_id, string_agg(part, '' ORDER BY pos) AS k FROM parts GROUP BY 1),
counted AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
