"""Repeated byte strings: suffixes dealt by range with sampled splitters, sorted in each bucket, compared across its borders.

All strings of ``size`` bytes that start in some document are looked up among those of all documents with a
smaller id.  A suffix counts by its first ``size`` bytes, so consecutive suffixes that share their least
token (the least hash of the ``TOKEN`` bytes at each place in them) are dealt as one *run* by that token:
equal suffixes have equal tokens at equal places and meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_bytes, map_arrow, mix, new_folder, prepare, released

#: Bytes of a token.
TOKEN = 16
#: Bytes that one vectorised step takes, and bytes of text whose equal runs are merged before the shuffle.
STEP, SCOPE = 1 << 17, 4 << 20
#: Bytes of runs that a bucket is to hold, and sampled tokens for each bucket.
BUCKET, SAMPLE = 16 << 20, 40
#: Bytes of runs for each byte of text, about.
_SPREAD = 4
#: Windows that a step of the local sort handles.
_PART = 1 << 20
_PLACE = U64((1 << 21) - 1)
_K = list(np.random.default_rng(7).integers(1, 2**63, 16).astype(U64) * U64(2) + U64(1))


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as little-endian numbers."""
    n = len(raw) - 7
    out = np.empty(n, "<u8")
    for o in range(8):
        out[o::8] = raw[o : o + (len(raw) - o) // 8 * 8].view("<u8")
    return out


def _reversed(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").byteswap()


_HEAD = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], U64)


class Runs:
    """Runs of consecutive windows: ``cells`` holds the bytes, zero-padded, ``length`` how many, ``token`` the token's place."""

    def __init__(self, cells, length, token, doc, place):
        self.cells, self.length, self.token, self.doc, self.place = cells, length, token, doc, place

    def take(self, at) -> Runs:
        return Runs(self.cells[at], self.length[at], self.token[at], self.doc[at], self.place[at])


def runs_of(pieces: list[tuple[int, int, bytes]], size: int = 50) -> Runs:
    """The runs of some pieces (document, place of its first byte, bytes), together less than 2^21 bytes."""
    wide, cells = size - TOKEN + 1, (2 * size - TOKEN + 7) // 8
    length = np.array([len(p[2]) for p in pieces], np.int64)
    ends = np.cumsum(length)
    n = int(ends[-1]) if len(ends) else 0
    raw = np.frombuffer(b"".join(p[2] for p in pieces) + bytes(2 * size + 8 * cells), np.uint8)
    eight = _words(raw)
    h = eight[:n] * _K[0] + (eight[8 : n + 8] ^ (eight[8 : n + 8] >> U64(29))) * _K[1]
    h ^= h >> U64(32)
    h *= _K[2]
    least = np.full(n + wide, 2**64 - 1, U64)
    least[:n] = (h & ~_PLACE) | np.arange(n, dtype=U64)
    reach = 1
    while 2 * reach <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:n], least[wide - reach : wide - reach + n])
    starts = np.flatnonzero(np.arange(n) <= np.repeat(ends - size, length))
    token = (least[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (starts[1:] != starts[:-1] + 1)))) if len(starts) else starts
    at = starts[first]
    length_of = np.diff(np.append(first, len(starts))) + size - 1
    out = np.empty((len(at), cells), "<u8")
    for k in range(cells):
        out[:, k] = eight[at + 8 * k] & _HEAD[np.clip(length_of - 8 * k, 0, 8)]
    piece = np.searchsorted(ends, at, side="right")
    base = np.array([p[1] for p in pieces], np.int64) - (ends - length)
    return Runs(out, length_of, token[first] - at, np.array([p[0] for p in pieces], np.int64)[piece], at + base[piece])


def pieces_of(texts: list[tuple[int, bytes]], size: int = 50, step: int = STEP) -> Iterator[list[tuple[int, int, bytes]]]:
    """Steps of whole texts; a longer text is cut into pieces that overlap, so no window is lost or doubled."""
    held, total = [], 0
    for doc, text in texts:
        for start in range(0, max(1, len(text) - size + 1), step):
            piece = text[start : start + step + size - 1]
            if held and total + len(piece) > step:
                yield held
                held, total = [], 0
            held.append((doc, start, piece))
            total += len(piece)
    if held:
        yield held


def multikey(rows: np.ndarray, character, depth: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by multikey quicksort over characters of eight bytes: what is equal so far goes on to the next character.

    ``character(k, rows)`` gives the k-th character of rows; ``group`` (ascending) keeps rows apart from the start.
    Returns the rows in order and, for each, the position of the first one equal to it.
    """
    rows = rows.copy()
    n = len(rows)
    first = np.zeros(n, np.int64) if group is None else _firsts(group[1:] != group[:-1], n)
    for k in range(depth):
        size = np.bincount(first, minlength=n)
        open_ = np.flatnonzero(size[first] > 1)
        if not len(open_):
            break
        own = rows[open_]
        key = character(k, own)
        order = np.lexsort((key, first[open_]))
        own, key, old = own[order], key[order], first[open_]
        rows[open_] = own
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (old[1:] != old[:-1])))
        first[open_] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
    return rows, first


def _firsts(change: np.ndarray, n: int) -> np.ndarray:
    """For each place the start of its stretch; ``change`` says where stretches begin after the first place."""
    if not n:
        return np.zeros(0, np.int64)
    new = np.concatenate(([True], change))
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _leading(cells: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The two characters of each run's token, big-endian, so that their order is the bytes' order."""
    flat = np.ascontiguousarray(cells).view(np.uint8)
    own = np.take_along_axis(flat, token[:, None] + np.arange(TOKEN), axis=1)
    return np.ascontiguousarray(own).view(">u8").astype(U64)


def _as_text(leading: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(leading.astype(">u8")).view(f"S{TOKEN}").ravel()


_CODEC = pa.Codec("zstd", compression_level=3)
_PARTS = [("cells", "u1"), ("length", "u1"), ("token", "u1"), ("many", "<u4"), ("doc", "<u4"), ("place", "<u4"), ("ids", "<i8"), ("texts", "<i8")]


def _pack(parts: dict[str, np.ndarray]) -> bytes:
    out = []
    for name, kind in _PARTS:
        raw = np.ascontiguousarray(parts[name].astype(kind, copy=False)).tobytes()
        packed = _CODEC.compress(raw, asbytes=True) if raw else b""
        out += [len(raw).to_bytes(8, "little"), len(packed).to_bytes(8, "little"), packed]
    return b"".join(out)


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, kind in _PARTS:
        size, packed = (int.from_bytes(raw[at + i : at + i + 8], "little") for i in (0, 8))
        at += 16
        out[name] = np.frombuffer(_CODEC.decompress(raw[at : at + packed], size, asbytes=True) if size else b"", kind)
        at += packed
    return out


def _spans(ids, texts, doc, start, stop) -> Iterator[tuple[int, int, bytes]]:
    """(id, text hash, spans) for each document among the spans, overlapping ones merged."""
    if not len(doc):
        return
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    for i, j in zip(heads, np.append(heads[1:], len(doc)), strict=True):
        yield int(ids[doc[i]]), int(texts[doc[i]]), merged(start[i:j], stop[i:j]).tobytes()


def merged(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Maximal runs of spans that are sorted by start, as rows (start, end)."""
    if not len(start):
        return np.zeros((0, 2), "<u4")
    far = np.maximum.accumulate(stop)
    new = np.concatenate(([True], start[1:] > far[:-1]))
    return np.stack([start[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(far) - 1)]], axis=1).astype("<u4")


def _classes(r: Runs, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal runs merged: (rows in order, class of each, least id of each class); only equal bytes share a class."""
    h = r.length.astype(U64) * _K[14] + r.token.astype(U64) * _K[15]
    for k in range(r.cells.shape[1]):
        h = h * _K[13] + r.cells[:, k] * _K[k % 13]
        h ^= h >> U64(31)
    order = np.lexsort((doc_id, mix(h)))
    a, b = order[:-1], order[1:]
    same = (r.length[a] == r.length[b]) & (r.token[a] == r.token[b])
    for k in range(r.cells.shape[1]):
        same &= r.cells[a, k] == r.cells[b, k]
    klass = np.concatenate(([0], np.cumsum(~same))) if len(order) else np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else order
    return order, klass, np.minimum.reduceat(doc_id[order], head) if len(order) else doc_id


def _deal(batches, splitters: np.ndarray, size: int, scope: int):
    """Packets of merged runs by bucket; spans that a smaller id in the same scope has already decided go along, under any bucket."""
    held: list[Runs] = []
    ids, texts, number, taken, total = [], [], {}, set(), 0

    def flush():
        if not held:
            return
        r = Runs(*(np.concatenate([getattr(x, n) for x in held]) for n in ("cells", "length", "token", "doc", "place")))
        held.clear()
        own_ids, own_texts = np.array(ids, np.int64), np.array(texts, np.int64)
        order, klass, least = _classes(r, own_ids[r.doc])
        doc = r.doc[order]
        later = own_ids[doc] > least[klass]
        gone = order[later]
        for n, (i, t, spans) in enumerate(_spans(own_ids, own_texts, r.doc[gone], r.place[gone], r.place[gone] + r.length[gone])):
            yield n % (len(splitters) + 1), i, t, spans
        order, klass = order[~later], klass[~later]
        head = np.flatnonzero(np.concatenate(([True], klass[1:] != klass[:-1])))
        many = np.diff(np.append(head, len(order)))
        lead = order[head]
        leading = _leading(r.cells[lead], r.token[lead])
        key = _as_text(leading)
        low, high = np.searchsorted(splitters, key, "left"), np.searchsorted(splitters, key, "right")
        spread = mix(r.cells[lead].sum(axis=1, dtype=U64)) % np.maximum(high - low, 1).astype(U64)
        bucket = np.where(high - low > 1, low + 1 + spread.astype(np.int64), high)
        by = np.lexsort((leading[:, 1], leading[:, 0], bucket))
        cut = np.searchsorted(bucket[by], np.arange(len(splitters) + 2))
        starts = head[by]
        for b in np.flatnonzero(np.diff(cut)):
            own = slice(cut[b], cut[b + 1])
            at, n = lead[by[own]], many[by[own]]
            rows = order[np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            used, local = np.unique(r.doc[rows], return_inverse=True)
            flat = r.cells[at].view(np.uint8).reshape(len(at), -1)
            parts = {"cells": flat[np.arange(flat.shape[1]) < r.length[at][:, None]], "length": r.length[at], "token": r.token[at], "many": n}
            yield int(b), None, None, _pack(parts | {"doc": local, "place": r.place[rows], "ids": own_ids[used], "texts": own_texts[used]})

    def rows(out):
        cols = list(zip(*out, strict=True))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "id", "text", "data"])

    def emit():
        nonlocal total
        out, size_ = [], 0
        for x in flush():
            out.append(x)
            size_ += len(x[3])
            if size_ > (4 << 20):
                yield rows(out)
                out, size_ = [], 0
        if out:
            yield rows(out)
        for x in (held, ids, texts, number, taken):
            x.clear()
        total = 0

    for b in batches:
        new = []
        for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
            if t and len(t) >= size and (i, h) not in taken:
                taken.add((i, h))
                new.append(((i, h), t))
        for step in pieces_of(new, size):
            for own, _, _ in step:
                if own not in number:
                    number[own] = len(ids)
                    ids.append(own[0])
                    texts.append(own[1])
            held.append(runs_of([(number[own], at, piece) for own, at, piece in step], size))
            total += sum(len(p[2]) for p in step)
            if total > scope:
                yield from emit()
    yield from emit()


def solve(packets: list[dict[str, np.ndarray]], size: int, shared: np.ndarray):
    """Spans of a bucket, and windows left open because their token (among ``shared``) fills several buckets.

    Returns (ids, texts, doc, start, stop, (window bytes, doc, place)).
    """
    cells = (2 * size - TOKEN + 7) // 8
    length = np.concatenate([p["length"] for p in packets]).astype(np.int64)
    flat = np.zeros((len(length), 8 * cells), np.uint8)
    at = 0
    for p in packets:  # one after the other, so that no second copy of all is made
        own = flat[at : at + len(p["length"])]
        own[np.arange(8 * cells) < p["length"][:, None]] = p.pop("cells")
        at += len(own)
    shift = np.cumsum([0] + [len(p["ids"]) for p in packets])
    ids, texts = (np.concatenate([p[n] for p in packets]) for n in ("ids", "texts"))
    doc = np.concatenate([p["doc"].astype(np.int64) + s for p, s in zip(packets, shift, strict=False)])
    place = np.concatenate([p["place"] for p in packets]).astype(np.int64)
    token = np.concatenate([p["token"] for p in packets]).astype(np.int64)
    many = np.concatenate([p["many"] for p in packets]).astype(np.int64)
    run_of = np.repeat(np.arange(len(many)), many)
    own = ids[doc]
    heads = np.cumsum(many) - many
    low, high = np.minimum.reduceat(own, heads), np.maximum.reduceat(own, heads)

    whole = flat.view("<u8")
    lead = _leading(whole, token)
    rows, first = multikey(np.arange(len(length)), lambda k, r: lead[r, k], 2)
    heads = np.flatnonzero(first == np.arange(len(first)))
    alike = np.diff(np.append(heads, len(rows)))
    hot = np.isin(_as_text(lead[rows[heads]]), shared)
    live = (np.minimum.reduceat(low[rows], heads) < np.maximum.reduceat(high[rows], heads)) | hot
    keep = np.repeat(live, alike)
    rows, group = rows[keep], np.repeat(np.arange(len(heads)), alike)[keep]
    if not len(rows):
        none = np.zeros(0, np.int64)
        return ids, texts, none, none, none, (np.zeros((0, size), np.uint8), none, none)

    # equal runs of several scopes become one class
    shape = (token << 8 | length).astype(U64)
    rows, first = multikey(rows, lambda k, r: shape[r] if k == 0 else whole[r, k - 1], cells + 1, group)
    group = group[first]
    heads = np.flatnonzero(first == np.arange(len(first)))
    klass = np.full(len(length), -1)
    klass[rows] = np.cumsum(first == np.arange(len(first))) - 1
    least = np.minimum.reduceat(low[rows], heads)
    lead_row, group = rows[heads], group[heads]

    at = np.flatnonzero(klass[run_of] >= 0)
    run, its = run_of[at], klass[run_of[at]]
    later = own[at] > least[its]
    found = [(doc[at][later], place[at][later], place[at][later] + length[run[later]])]

    # runs with the same token but other bytes around it: the windows themselves are sorted
    alone = np.diff(np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(group)))
    mixed = np.flatnonzero(np.repeat(alone > 1, alone) | hot[group])
    windows = length[lead_row] - size + 1
    open_w, open_d, open_p = [], [], []
    at, its = at[~later], its[~later]
    order = np.argsort(its, kind="stable")
    at, its = at[order], its[order]
    low_at, high_at = np.searchsorted(its, np.arange(len(heads))), np.searchsorted(its, np.arange(len(heads)), "right")
    padded = np.zeros((len(mixed), 8 * cells + 8), np.uint8)
    padded[:, : 8 * cells] = flat[lead_row[mixed]]
    eight = _words(np.concatenate([padded.ravel(), np.zeros(size + 8, np.uint8)]))
    tail = _HEAD[size - size // 8 * 8] if size % 8 else None
    chars = -(-size // 8)
    start = 0
    total = np.cumsum(windows[mixed])
    while start < len(mixed):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _PART, "right")))
        while stop < len(mixed) and group[mixed[stop]] == group[mixed[stop - 1]]:
            stop += 1
        part = mixed[start:stop]
        n = windows[part]
        which = np.repeat(np.arange(len(part)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        base = (start + which) * (8 * cells + 8) + nth
        key = group[part][which] * 256 + token[lead_row[part]][which] - nth
        by = np.argsort(key, kind="stable")

        def char(k, r, base=base):
            x = eight[base[r] + 8 * k]
            return _reversed(x & tail if tail is not None and k == chars - 1 else x)

        sorted_, first = multikey(by, char, chars, key[by])
        new = first == np.arange(len(first))
        best = np.empty(len(by), np.int64)
        best[sorted_] = np.minimum.reduceat(least[part][which[sorted_]], np.flatnonzero(new))[np.cumsum(new) - 1]
        covered = best < least[part][which]
        # the class's first documents have the windows that are covered; in an open token all other windows stay open
        lo, hi = low_at[part], high_at[part]
        for flag, out in ((covered, found), (hot[group[part]][which] & ~covered, None)):
            hit = np.flatnonzero(flag)
            if not len(hit):
                continue
            c = which[hit]
            times = hi[c] - lo[c]
            occ = at[np.repeat(lo[c] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            w = np.repeat(nth[hit], times)
            if out is not None:
                out.append((doc[occ], place[occ] + w, place[occ] + w + size))
            else:
                byte = np.repeat(base[hit], times)
                open_w.append(np.concatenate([padded.ravel(), np.zeros(size, np.uint8)])[byte[:, None] + np.arange(size)])
                open_d.append(doc[occ])
                open_p.append(place[occ] + w)
        start = stop
    d, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
    opened = (np.concatenate(open_w), np.concatenate(open_d), np.concatenate(open_p)) if open_w else (np.zeros((0, size), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return ids, texts, d, s, e, opened


_FOUND = pa.schema([("id", pa.int64()), ("text", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("window", pa.binary())])


def _solved(table: pa.Table, size: int, shared: np.ndarray) -> pa.Table:
    """One row for each span, and for each window that is still open."""
    none = np.zeros(0, np.int64)
    id_, text, start, stop, packets = [none], [none], [none], [none], []
    for i, t, data in zip(*(table.column(n).to_pylist() for n in ("id", "text", "data")), strict=True):
        if i is None:
            packets.append(_unpack(data))
        else:
            own = np.frombuffer(data, "<u4").reshape(-1, 2).astype(np.int64)
            for out, x in zip((id_, text, start, stop), (np.full(len(own), i), np.full(len(own), t), own[:, 0], own[:, 1]), strict=True):
                out.append(x)
    windows = none
    if packets:
        ids, texts, doc, first, last, (windows, its, place) = solve(packets, size, shared)
        for out, x in zip((id_, text, start, stop), ((ids[doc], ids[its]), (texts[doc], texts[its]), (first, place), (last, place + size)), strict=True):
            out += x
    n = sum(map(len, id_))
    window = pa.array([None] * (n - len(windows)) + [w.tobytes() for w in windows], pa.binary())
    return pa.Table.from_arrays([*(pa.array(np.concatenate(x), pa.int64()) for x in (id_, text, start, stop)), window], schema=_FOUND)


def _sampled(batches, size: int, every: int):
    """Tokens of every so manieth run of the sampled texts, equal runs of a scope counted once as in the shuffle."""
    for b in batches:
        texts = [((i, h), t) for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True) if t and len(t) >= size]
        out = []
        for step in pieces_of(texts, size):
            r = runs_of([(i, at, piece) for (i, _), at, piece in step], size)
            order, klass, _ = _classes(r, r.doc)
            r = r.take(order[np.flatnonzero(np.diff(klass, prepend=-1))])
            own = mix(r.doc.astype(U64) * _K[3] + r.place.astype(U64)) % U64(every) == 0
            out += [x.tobytes() for x in np.ascontiguousarray(_leading(r.cells[own], r.token[own]).astype(">u8"))]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["token"])


def splitters_of(rows: DataFrame, total: int, size: int, bucket: int) -> np.ndarray:
    """Splitters between about ``total`` * 4 / ``bucket`` buckets, from a sample of ``SAMPLE`` tokens for each."""
    buckets = -(-total * _SPREAD // bucket)
    if buckets < 2:
        return np.zeros(0, f"S{TOKEN}")
    share = max(1, min(16, total // (buckets << 18)))  # of the texts, so that each bucket has 256 KB of them
    every = max(1, total // share // (TOKEN + 2) // (SAMPLE * buckets))
    part = rows.where(F.pmod(F.xxhash64("text_hash"), F.lit(share)) == 0) if share > 1 else rows
    found = np.sort(np.array([bytes(x[0]) for x in part.mapInArrow(lambda b: _sampled(b, size, every), "token binary").collect()], f"S{TOKEN}"))
    return found[(np.arange(1, buckets) * len(found)) // buckets] if len(found) else found


def repeated(docs: DataFrame, size: int = 50, bucket: int = BUCKET, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, start, stop): spans of the documents that are covered by strings of ``size`` bytes of a smaller doc_id; spans may overlap.

    Runs are merged within ``scope`` bytes of text (what a smaller id there has is decided at once), dealt by
    range of their token and sorted within buckets of about ``bucket`` bytes.  A token that fills several
    buckets is dealt over them by its run; its windows are compared across these by a minimum that Spark
    combines before the shuffle.  Documents of equal ids and texts count once; a null id has no smaller or larger one.
    """
    if not TOKEN <= size <= 120:
        raise ValueError(f"strings must have {TOKEN} to 120 bytes")
    spark = prepare(docs.sparkSession)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    folder = new_folder(spark, "suffixes")
    with released(spark):  # the packets are larger than the texts, which are shuffled after them
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        splitters = splitters_of(rows, total, size, bucket)
        shared = np.unique(splitters[1:][splitters[1:] == splitters[:-1]])
        dealt = rows.mapInArrow(lambda b: _deal(b, splitters, size, scope), "bucket int, id long, text long, data binary")
        done = dealt.repartition(len(splitters) + 1, "bucket").groupBy("bucket").applyInArrow(lambda t: _solved(t, size, shared), "id long, text long, start long, stop long, window binary")
        done.write.mode("overwrite").parquet(folder)
    done = spark.read.parquet(folder)
    spans = ["id", "text", "start", "stop"]
    still = done.where("window IS NOT NULL")
    least = still.groupBy("window").agg(F.min("id").alias("least"))
    across = still.join(least, "window").where("id > least").select(*spans)
    return done.where("window IS NULL").select(*spans).unionByName(across).withColumnsRenamed({"id": "doc_id", "text": "text_hash"})


def _kept(batches):
    for b in batches:
        lists = b.column(2)
        offsets = np.asarray(lists.offsets)
        start, stop = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        out = []
        for text, i, j in zip(as_bytes(b.column(1)), offsets, offsets[1:], strict=False):
            text = text or b""
            order = np.argsort(start[i:j], kind="stable") + i
            own = merged(start[order], stop[order]).tolist()
            edges = [0, *(x for pair in own for x in pair), len(text)]
            out.append((len(text), [{"start": s, "end": e} for s, e in own], b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))))
        n, spans, kept = zip(*out, strict=True) if out else ((), (), ())
        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip((n, spans, kept), kinds, strict=True))], ["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, size: int = 50, bucket: int = BUCKET, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of docs (doc_id, an integer; text): the maximal removed runs and the bytes left.

    A byte goes if a string of ``size`` bytes around it also starts in a document with a smaller doc_id.
    Null texts count as empty.  Rows with a null doc_id lose nothing and take nothing from others; rows that
    share a doc_id don't take from each other, and equal rows get equal results.  Cuts may fall inside a character.
    """
    found = repeated(docs, size, bucket, scope).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    joined = rows.join(found.withColumnRenamed("doc_id", "id"), ["id", "text_hash"], "left").select("doc_id", "text", "found")
    return map_arrow(joined, joined.columns, _kept, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
