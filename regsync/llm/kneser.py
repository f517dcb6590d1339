"""Language-model scoring: an interpolated modified Kneser-Ney trigram model in memory-mapped sorted hash arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, as_bytes, mix, new_folder, open_arrays, prepare, steps, write_arrays

#: Hashes of the text's end, which is a token, and of the text's start, which is only a context.
END, START = U64(1), U64(2)
#: Characters of training text for each partition of the model, tokens counted before a task passes its counts on.
PARTITION_CHARS, FLUSH = 16 << 20, 4 << 20
_STEP = 1 << 20
_GOLD = U64(0x9E3779B97F4A7C15)


# hashes and partitions
def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.astype(U64) + _GOLD) + b.astype(U64))


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(_pair(a, b) * _GOLD + c.astype(U64))


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a hash: equal ranges, so the partitions' sorted arrays in order are one sorted array."""
    return ((h >> U64(32)) * U64(parts)) >> U64(32)


def _cut(part: np.ndarray, *arrays):
    """(partition, slices of the arrays) for ascending partitions."""
    heads = _heads(part)
    for a, z in zip(heads, np.append(heads, len(part))[1:], strict=True):
        yield int(part[a]), [x[a:z] for x in arrays]


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


# packets: columns of numbers on their way through a shuffle
def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each in as few bytes as its largest number needs, byte by byte, compressed."""
    n, planes, widths = len(columns[0]), [], []
    for c in columns:
        c = np.ascontiguousarray(c, U64)
        width = max(1, -(-int(c.max()).bit_length() // 8)) if n else 1
        planes.append(c.view(np.uint8).reshape(n, 8)[:, :width].T.tobytes())
        widths.append(width)
    return bytes([len(widths), *widths]) + n.to_bytes(8, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> list[np.ndarray]:
    k = data[0]
    widths, n = data[1 : k + 1], int.from_bytes(data[k + 1 : k + 9], "little")
    raw = np.frombuffer(pa.decompress(data[k + 9 :], n * sum(widths), codec="zstd"), np.uint8)
    out, at = [], 0
    for width in widths:
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(full.view(U64).reshape(n))
        at += n * width
    return out


def _rows(rows, *kinds):
    """A record batch of the rows (names a, b, c ...)."""
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], list("abcdefgh"[: len(kinds)]))


def _by_partition(function):
    """Calls function(p, rows) for all rows of a partition; the input is sorted by p."""

    def run(batches):
        now, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is not None and row[0] != now:
                    yield function(now, held)
                    held = []
                now = row[0]
                held.append(row[1:])
        if now is not None:
            yield function(now, held)

    return run


# arrays of a partition
def _counts(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Whole numbers of any size as one byte each; 255 stands for those that are listed apart."""
    over = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype(np.uint8), f"{name}_at": over.astype(np.int64), f"{name}_is": values[over].astype(np.int64)}


def _count_at(held: dict[str, np.ndarray], name: str, place: np.ndarray) -> np.ndarray:
    out = held[name][place].astype(np.int64)
    over = np.flatnonzero(out == 255)
    if len(over):
        out[over] = held[f"{name}_is"][np.searchsorted(held[f"{name}_at"], place[over])]
    return out


def _keys(name: str, code: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hashes, of which 48 bits are kept."""
    return {f"{name}_high": (code >> U64(32)).astype(np.uint32), f"{name}_low": (code >> U64(16)).astype(np.uint16)}


def _find(held: dict[str, np.ndarray], name: str, code: np.ndarray) -> np.ndarray:
    """The place of each hash, -1 where it isn't there."""
    high, low = held[f"{name}_high"], held[f"{name}_low"]
    out = np.full(len(code), -1, np.int64)
    if not len(high):
        return out
    h, x = (code >> U64(32)).astype(np.uint32), (code >> U64(16)).astype(np.uint16)
    place, open_ = np.searchsorted(high, h), np.arange(len(code))
    while len(open_):
        open_ = open_[place[open_] < len(high)]
        open_ = open_[high[place[open_]] == h[open_]]
        hit = low[place[open_]] == x[open_]
        out[open_[hit]] = place[open_[hit]]
        open_ = open_[~hit]
        place[open_] += 1
    return out


# tokens
def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then the end), and the places of the ends."""
    words = Words(texts)
    n = len(texts)
    ends = np.cumsum(words.count) + np.arange(n)
    out = np.empty(len(words.hash) + n, U64)
    own = np.ones(len(out), bool)
    own[ends] = False
    out[ends] = END
    out[own] = words.hash
    return out, ends


def _before(values: np.ndarray, ends: np.ndarray, start) -> np.ndarray:
    """The value one place before each, ``start`` at a text's first."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[np.concatenate(([0], ends[:-1] + 1))] = start
    return out


def _batches_of_tokens(batches):
    for b in batches:
        for _, texts in steps(as_bytes(b.column(0)), _STEP):
            yield tokens(texts)


# words
def _counted(parts):
    """Rows (p, hashes, counts) of a task's words, summed as far as memory allows."""

    def run(batches):
        held, total = [], 0

        def flush():
            h, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            c = np.bincount(inverse, np.concatenate([x for _, x in held])).astype(np.int64)
            return _rows([(p, x.tobytes(), _packed(y)) for p, (x, y) in _cut(_part(h, parts), h, c)], pa.int32(), pa.binary(), pa.binary())

        for tok, ends in _batches_of_tokens(batches):
            h, c = np.unique(np.concatenate([tok, np.full(len(ends), START)]), return_counts=True)
            held.append((h, c))
            total += len(h)
            if total > FLUSH:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    return run


def _write_words(folder):
    def work(p, rows):
        h, inverse = np.unique(np.concatenate([np.frombuffer(r[0], U64) for r in rows]), return_inverse=True)
        c = np.zeros(len(h), np.int64)
        np.add.at(c, inverse, np.concatenate([_unpacked(r[1])[0] for r in rows]).astype(np.int64))
        write_arrays(folder, f"word-{p}", {"hash": h} | _counts("count", c))
        return _rows([(p, len(h), int(c.sum()))], pa.int32(), pa.int64(), pa.int64())

    return _by_partition(work)


class Model:
    """The arrays of a trained model, opened by a worker when first needed.

    word-p: sorted hashes of the words of range p and their counts; a word's id is its place in all ranges together.
    stat-p: before how many words each of them stands, and the sum and the numbers of counts 1, 2 and more of what follows it.
    gram-p: sorted hashes and counts of trigrams (u, v, w), with the same four numbers for contexts (u, v) that occur more than
    once, and bigrams (v, w) with how many words stand before them.  pair-p: bigrams of the frequent words v of ``hot``.
    """

    def __init__(self, folder: str, parts: int, offsets: np.ndarray):
        self.folder, self.parts, self.offsets = folder, parts, offsets
        self.hot = np.zeros(0, np.int64)
        self.start = -1
        self.total = self.kinds = self.pairs = 0
        self.discounts = [(0.0, 0.0, 0.0)] * 3
        self.spare = 1.0
        self.full: set[str] = set()
        self._open: dict[str, dict[str, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def held(self, name: str) -> dict[str, np.ndarray]:
        if name not in self._open:
            self._open[name] = open_arrays(self.folder, name)
        return self._open[name]

    def words(self, h: np.ndarray, statistics: bool = False):
        """For sorted hashes: ids (-1 if unknown) and, if asked for, a row of counts, words before, and the four numbers of what follows (0 if unknown)."""
        ids, values = np.full(len(h), -1, np.int64), np.zeros((len(h), 6), np.int64)
        for p, (x, at) in _cut(_part(h, self.parts), h, np.arange(len(h))):
            if self.offsets[p] == self.offsets[p + 1]:
                continue
            held = self.held(f"word-{p}")
            place = np.minimum(np.searchsorted(held["hash"], x), len(held["hash"]) - 1)
            ok = held["hash"][place] == x
            at, place = at[ok], place[ok]
            ids[at] = place + self.offsets[p]
            if statistics:
                values[at, 0] = _count_at(held, "count", place)
                more = self.held(f"stat-{p}")
                for i, name in enumerate(("before", "sum", "one", "two", "many"), 1):
                    values[at, i] = _count_at(more, name, place)
        return (ids, values) if statistics else ids

    def part(self, v: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What has v in its middle lies together; what has a very frequent v is dealt by ``code``."""
        return _part(np.where(np.isin(v, self.hot), code, mix(v.astype(U64) + U64(1))), self.parts)

    def look(self, kind: str, part: np.ndarray, code: np.ndarray, names: tuple[str, ...], files: np.ndarray | None = None) -> np.ndarray:
        """The named counts of each of ascending hashes in its partition's arrays, 0 where it isn't there; files: whether it is a frequent word's."""
        out = np.zeros((len(code), len(names)), np.int64)
        order = np.argsort(part.astype(np.uint16) if self.parts < 1 << 16 else part, kind="stable")
        for p, (x, at) in _cut(part[order], code[order], order):
            for prefix, own in (("gram", slice(None)),) if files is None else (("gram", ~files[at]), ("pair", files[at])):
                file, y, to = f"{prefix}-{p}", x[own], at[own]
                if not len(y) or file not in self.full:
                    continue
                held = self.held(file)
                place = _find(held, kind, y)
                ok = place >= 0
                for i, name in enumerate(names):
                    out[to[ok], i] = _count_at(held, name, place[ok])
        return out

    def _share(self, level: int, count, numbers, lower):
        """The interpolated probability at a level from the count, the context's four numbers and the lower level's."""
        d1, d2, d3 = self.discounts[level]
        cut = np.select([count >= 3, count == 2, count == 1], [d3, d2, d1], 0.0)
        total = np.maximum(numbers[:, 0], 1)
        return np.where(numbers[:, 0] > 0, (count - cut + (numbers[:, 1:] @ np.array([d1, d2, d3])) * lower) / total, lower)

    def score(self, texts: list[bytes]):
        """(tokens, known tokens, base log10, model log10) of each text."""
        tok, ends = tokens(texts)
        sizes = np.diff(np.concatenate(([-1], ends)))
        if not self.total:
            zero = np.zeros(len(texts))
            return sizes, zero.astype(np.int64), zero, zero
        kinds, at = np.unique(np.concatenate([tok, [START]]), return_inverse=True)
        ids, of = self.words(kinds, True)
        start, w = at[-1], at[:-1]
        count = of[:, 0]
        d1, d2, d3 = self.discounts[0]
        stands = of[:, 1]
        cut = np.select([stands >= 3, stands == 2, stands == 1], [d3, d2, d1], 0.0)
        single = (stands - cut) / max(self.pairs, 1) + self.spare / (self.kinds + 1.0)
        v = _before(w, ends, start)
        u = _before(v, ends, start)
        # bigrams: each is also the context of the next place
        two = np.flatnonzero((ids[v] >= 0) & (ids[w] >= 0))
        a, b = ids[v[two]], ids[w[two]]
        code, one, back = np.unique(_pair(a, b), return_index=True, return_inverse=True)
        adjusted = np.zeros(len(tok), np.int64)
        adjusted[two] = self.look("pair", self.part(a[one], code), code, ("adjusted",), np.isin(a[one], self.hot))[back, 0]
        p = self._share(1, adjusted, of[v][:, 2:], single[w])
        # contexts of two words: those that occur once are only known as bigrams
        seen = _before(adjusted, ends, 0) > 0
        first = np.concatenate(([0], ends[:-1] + 1))
        begins = np.zeros(len(tok), bool)
        begins[first] = True
        three = np.flatnonzero(seen | begins)
        a, b = ids[u[three]], ids[v[three]]
        code, one, back = np.unique(_pair(a, b), return_index=True, return_inverse=True)
        found = self.look("context", self.part(b[one], code), code, ("sum", "one", "two", "many"))[back]
        found[(found[:, 0] == 0) & seen[three]] = (1, 1, 0, 0)
        numbers = np.zeros((len(tok), 4), np.int64)
        numbers[three] = found
        live = np.flatnonzero((numbers[:, 0] > 0) & (ids[w] >= 0))
        a, b, c = ids[u[live]], ids[v[live]], ids[w[live]]
        code, one, back = np.unique(_triple(a, b, c), return_index=True, return_inverse=True)
        occurs = np.zeros(len(tok), np.int64)
        occurs[live] = self.look("triple", self.part(b[one], _pair(a[one], b[one])), code, ("occurs",))[back, 0]
        p = self._share(2, occurs, numbers, p)
        base = np.log10((count + 1.0) / (self.total + self.kinds + 1.0))
        by_text = lambda x: np.add.reduceat(x, first)
        return sizes, by_text((count[w] > 0).astype(np.int64)), by_text(base[w]), by_text(np.log10(p))


# trigrams
def _trigrams(model: Model):
    """Rows (p, packet) of a task's trigrams and their counts, sorted by middle, first and last word."""

    def run(batches):
        held, total = [], 0
        kind = np.uint32 if model.offsets[-1] < 2**32 else U64

        def flush():
            u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((w, u, v))
            u, v, w = u[order], v[order], w[order]
            heads = _heads(v, u, w)
            c = np.diff(np.append(heads, len(u)))
            u, v, w = u[heads], v[heads], w[heads]
            part = model.part(v, _pair(u, v))
            order = np.argsort(part, kind="stable")
            out = []
            for p, (x, y, z, n) in _cut(part[order], u[order], v[order], w[order], c[order]):
                dy = np.diff(y, prepend=y[:1])
                dx = np.where(np.concatenate(([False], y[1:] == y[:-1])), np.diff(x, prepend=x[:1]), x)
                out.append((p, y[0].item(), _packed(dx, dy, z, n)))
            return _rows(out, pa.int32(), pa.int64(), pa.binary())

        for tok, ends in _batches_of_tokens(batches):
            kinds, at = np.unique(tok, return_inverse=True)
            w = model.words(kinds).astype(kind)[at]
            v = _before(w, ends, model.start)
            held.append((_before(v, ends, model.start), v, w))
            total += len(tok)
            if total > FLUSH:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    return run


def _sums(of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ascending ``of``: where each begins, and (sum, ones, twos, more) of its values."""
    heads = _heads(of)
    columns = (values, values == 1, values == 2, values > 2)
    return heads, np.column_stack([np.add.reduceat(c.astype(np.int64), heads) for c in columns]) if len(heads) else np.zeros((0, 4), np.int64)


def _of_counts(values: np.ndarray) -> np.ndarray:
    return np.array([(values == i).sum() for i in (1, 2, 3, 4)], np.int64)


def _to_owners(model: Model, kind: int, ids: np.ndarray, *columns: np.ndarray):
    """Rows (range of the words, kind, packet) for ascending word ids."""
    q = np.searchsorted(model.offsets, ids, side="right") - 1
    for r, cols in _cut(q, ids, *columns):
        yield r, kind, _packed(cols[0] - model.offsets[r], *cols[1:])


def _bigram_rows(model: Model, v: np.ndarray, w: np.ndarray, n: np.ndarray):
    """The rows that finished bigrams, sorted by v, send to the ranges of their words."""
    heads, numbers = _sums(v, n)
    yield from _to_owners(model, 0, v[heads].astype(np.int64), *numbers.T)
    last, before = np.unique(w, return_counts=True)
    yield from _to_owners(model, 1, last.astype(np.int64), before)


def _write_trigrams(model: Model):
    """Writes a partition's trigrams, contexts and bigrams; rows (q, kind, packet): followers 0, words before 1, bigrams of frequent words 2, counts of counts 3."""

    def work(p, rows):
        parts = []
        for first, data in rows:
            dx, dy, z, n = _unpacked(data)
            y = np.cumsum(dy) + U64(first)
            total = np.cumsum(dx)
            heads = _heads(y)
            base = np.repeat(total[heads] - dx[heads], np.diff(np.append(heads, len(y))))
            parts.append((total - base, y, z, n))
        u, v, w, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((w, u, v))
        u, v, w, n = u[order], v[order], w[order], n[order].astype(np.int64)
        heads = _heads(v, u, w)
        n = np.add.reduceat(n, heads)
        u, v, w = u[heads], v[heads], w[heads]
        code = _triple(u, v, w)
        order = np.argsort(code)
        arrays = _keys("triple", code[order]) | _counts("occurs", n[order])
        # contexts: u and v ascend together
        context = _heads(v, u)
        numbers = _sums(np.repeat(np.arange(len(context)), np.diff(np.append(context, len(u)))), n)[1]
        more = (numbers[:, 0] > 1) | (u[context] == U64(model.start)) & (v[context] == U64(model.start))
        code = _pair(u[context], v[context])[more]
        order = np.argsort(code)
        arrays |= _keys("context", code[order])
        for i, name in enumerate(("sum", "one", "two", "many")):
            arrays |= _counts(name, numbers[more][order, i])
        counts = [_of_counts(n), np.zeros(4, np.int64)]
        # bigrams: how many words stand before; those that begin a text count as often as they occur
        order = np.lexsort((w, v))
        value = np.where((u == U64(model.start)) & (v == U64(model.start)), n, 1)[order]
        y, z = v[order], w[order]
        heads = _heads(y, z)
        adjusted, y, z = np.add.reduceat(value, heads), y[heads], z[heads]
        hot = np.isin(y, model.hot)
        own = ~hot
        code = _pair(y[own], z[own])
        order = np.argsort(code)
        arrays |= _keys("pair", code[order]) | _counts("adjusted", adjusted[own][order])
        write_arrays(model.folder, f"gram-{p}", arrays)
        counts[1] = _of_counts(adjusted[own])
        out = [(p, 3, _packed(*counts)), *_bigram_rows(model, y[own], z[own], adjusted[own])]
        part = _part(_pair(y[hot], z[hot]), model.parts)
        order = np.argsort(part, kind="stable")
        out += [(q, 2, _packed(*cols)) for q, cols in _cut(part[order], y[hot][order], z[hot][order], adjusted[hot][order])]
        return _rows(out, pa.int32(), pa.int32(), pa.binary())

    return _by_partition(work)


def _write_pairs(model: Model):
    """Sums the bigrams of frequent words in a partition and writes them; rows as before."""

    def work(p, rows):
        v, w, n = (np.concatenate(x) for x in zip(*[_unpacked(r[1]) for r in rows], strict=True))
        order = np.lexsort((w, v))
        v, w, n = v[order], w[order], n[order].astype(np.int64)
        heads = _heads(v, w)
        n, v, w = np.add.reduceat(n, heads), v[heads], w[heads]
        code = _pair(v, w)
        order = np.argsort(code)
        write_arrays(model.folder, f"pair-{p}", _keys("pair", code[order]) | _counts("adjusted", n[order]))
        return _rows([(p, 4, _packed(np.zeros(4, np.int64), _of_counts(n))), *_bigram_rows(model, v, w, n)], pa.int32(), pa.int32(), pa.binary())

    return _by_partition(work)


def _write_statistics(model: Model):
    """Sums the rows of a word range and writes them; returns the counts of counts of all levels, the words before in all, and which arrays are there."""

    def work(q, rows):
        n = int(model.offsets[q + 1] - model.offsets[q])
        numbers, before, counts, files = np.zeros((n, 4), np.int64), np.zeros(n, np.int64), np.zeros((2, 4), np.int64), [0, 0]
        for kind, data in rows:
            at, *values = (x.astype(np.int64) for x in _unpacked(data))
            if kind == 0:
                numbers[at] += np.column_stack(values)
            elif kind == 1:
                before[at] += values[0]
            else:
                counts += [at, values[0]]
                files[kind - 3] = 1
        arrays = _counts("before", before)
        for i, name in enumerate(("sum", "one", "two", "many")):
            arrays |= _counts(name, numbers[:, i])
        write_arrays(model.folder, f"stat-{q}", arrays)
        more = np.array([(before == 1).sum(), (before == 2).sum(), (before >= 3).sum(), before.sum()], np.int64)
        return _rows([(q, np.concatenate([_of_counts(before), *counts, more]).tobytes(), *files)], pa.int32(), pa.binary(), pa.int32(), pa.int32())

    return _by_partition(work)


def discounts(n) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if min(n1, n2) <= 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)


def train(docs: DataFrame, partition_chars: int = PARTITION_CHARS) -> Model:
    """Counts all whole texts of docs (text; null: empty) and writes the model to a new folder in the shared one.

    Words and trigrams are counted in tasks, dealt as packed columns and summed in their partitions.  Trigrams are dealt by
    their middle word, so that contexts and bigrams lie whole in a partition; those of middle words that fill more
    than a partition are dealt by the context, and their bigrams are summed in one more shuffle.  The driver sees a few
    numbers for each partition and the ids of such words, of which there are fewer than partitions.  All counts are 64-bit.
    Hashes of n-grams are kept to 48 bits, so an unseen one is taken for a seen one about once in 10^8 lookups.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select("text")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(8, -(-chars // partition_chars))
    folder = new_folder(spark, "kneser")
    dealt = texts.mapInArrow(_counted(parts), "a int, b binary, c binary").repartition(parts, "a").sortWithinPartitions("a")
    sizes = dealt.mapInArrow(_write_words(folder), "a int, b bigint, c bigint").collect()
    lengths = np.zeros(parts + 1, np.int64)
    for r in sizes:
        lengths[r.a + 1] = r.b
    model = Model(folder, parts, np.cumsum(lengths))
    if not sizes:
        return model
    model.start = int(model.words(np.array([START]))[0])
    p = int(_part(np.array([START]), parts)[0])
    starts = int(_count_at(model.held(f"word-{p}"), "count", np.array([model.start - model.offsets[p]]))[0])
    model.total, model.kinds = sum(r.c for r in sizes) - starts, int(lengths.sum()) - 1
    least = max(1, model.total // parts)

    def frequent(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                if model.offsets[p] < model.offsets[p + 1]:
                    held = model.held(f"word-{p}")
                    count = _count_at(held, "count", np.arange(len(held["hash"])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(count > least) + model.offsets[p], pa.int64())], ["id"])

    model.hot = np.sort(np.array([r.id for r in spark.range(parts).mapInArrow(frequent, "id bigint").collect()], np.int64))
    by_part = lambda df, f, schema: df.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(f, schema)
    path, packets = new_folder(spark, "kneser-rows"), "a int, b int, c binary"
    by_part(texts.mapInArrow(_trigrams(model), "a int, b bigint, c binary"), _write_trigrams(model), packets).write.mode("overwrite").parquet(path)
    rows = spark.read.schema(packets).parquet(path)
    more = by_part(rows.where("b = 2"), _write_pairs(model), packets)
    found = by_part(rows.where("b <> 2").unionByName(more), _write_statistics(model), "a int, b binary, c int, d int").collect()
    sums = sum(np.frombuffer(bytes(r.b), np.int64) for r in found).reshape(4, 4)
    model.full = {f"gram-{r.a}" for r in found if r.c} | {f"pair-{r.a}" for r in found if r.d}
    model.discounts = [discounts(sums[0]), discounts(sums[2]), discounts(sums[1])]
    model.pairs = int(sums[3][3])
    model.spare = float(np.dot(model.discounts[0], sums[3][:3])) / max(model.pairs, 1)
    _fill_statistics(model, {r.a for r in found})
    return model


def _fill_statistics(model: Model, there: set[int]) -> None:
    """Empty statistics for word ranges that no row reached."""
    for q in range(model.parts):
        n = int(model.offsets[q + 1] - model.offsets[q])
        if n and q not in there:
            write_arrays(model.folder, f"stat-{q}", {k: v for name in ("before", "sum", "one", "two", "many") for k, v in _counts(name, np.zeros(n, np.int64)).items()})


def perplexity(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """columns of docs with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text).

    A null text is an empty one, whose only token is its end.
    """
    prepare(docs.sparkSession)
    kinds = dict(docs.dtypes)
    made = ["n_tokens", "n_known", "base_score", "score"]

    def work(batches):
        for b in batches:
            parts = [model.score(t) for _, t in steps(as_bytes(b.column("__text")), _STEP)]
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *[pa.array(x) for x in cols]], [*columns, *made])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["n_tokens bigint, n_known bigint, base_score double, score double"])
    out = docs.select(*columns, F.col("text").alias("__text")).mapInArrow(work, schema)
    return out.withColumn("train_tokens", F.lit(model.total).cast("long"))
