"""HTML extraction: page structure, and a suffix array of each host's token streams that finds its boilerplate."""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, new_folder, open_array, prepare, write_array
from .urls import parts as parts_of_url

#: Tokens of the shortest repeated run that counts as boilerplate, pages that a suffix array covers, distinct pages of a host that must have a run, whatever the host's size.
RUN, SHARD_PAGES, LEAST_PAGES = 8, 512, 3
#: Distinct hosts up to which their page counts are broadcast.
BROADCAST_HOSTS = 100_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg canvas audio video textarea select option title noembed noframes".split())
_OUT = frozenset("nav header footer aside form head menu dialog button label fieldset".split())
_MAIN = frozenset("article main".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd mark q s samp small span strike strong sub sup time tt u var ruby rt rp wbr img object math mrow mi mo mn mtext mfrac msup msub msqrt mstyle".split())
#: Parts of a class or id that name what is not the article, outside of articles.
_BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner cookie cookies consent gdpr notice notices alert sidebar aside widget widgets menu nav navbar navigation "
    "breadcrumb breadcrumbs masthead footer comment comments commentlist disqus promo promoted sponsor sponsored newsletter subscribe subscription signup "
    "social related recommended recommendations popup modal overlay toolbar pagination pager login copyright disclaimer contentinfo complementary dialog".split()
)
_COMMENT = frozenset("comment comments commentlist disqus".split())
#: Inside an article whole class or id values count, of comment sections and of the rest; parts of values (these and ``_BAD``) only cast doubt.
_COMMENTS = frozenset("comment comments commentlist comment-list comments-list comments-area comment-section comments-section reader-comments user-comments disqus disqus_thread".split())
_ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense ad-banner ad-box ad-container ad-slot ad-unit sponsored cookie-banner cookie-notice cookie-consent notice notices sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs masthead footer site-footer site-header page-header newsletter newsletter-signup social-share share-buttons share-bar related related-articles related-posts pagination login-form search-form contact-form".split()
)
_DOUBT = _BAD | frozenset("header share sharing search form skip reply replies respond".split())
#: Roles by the standard, outside of articles and inside.
_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
#: Class or id values that name the article where no element does.
_NAMED = frozenset("article content post entry story main maincontent main-content main_content article-body article_body articlebody entry-content post-content post-body story-body".split())
_SPECIAL = re.compile("[\"'>]")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_PARTS = re.compile(r"[-_:\s]+")
OUTSIDE, MAIN, NAMED, PLAIN = 0, 1, 2, 3
_FILL = U64(1)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_START = (False, False, False, False, 0, False, False, 0)


class Tags:
    """The tags of a page, in time linear in its length whatever it holds: a quote that nothing closes is an ordinary character, and what nothing ends is looked for once."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        at = self.page.find(what, at)
        if at < 0:
            self.missing.add(what)  # nor is it anywhere later
        return at

    def end(self, at: int) -> int:
        """The place of the > that ends the tag: the first outside quotes, else the first."""
        first = self.find(">", at)
        while first >= 0 and (m := _SPECIAL.search(self.page, at)):
            if m[0] == ">":
                return m.start()
            other = self.find(m[0], m.end())
            at = m.end() if other < 0 else other + 1
        return first

    def next(self, at: int):
        """(start, end, closing, tag, attributes) of the next tag, comment or declaration (tag ''), or None."""
        page = self.page
        while (start := self.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            if page[start + 1 : start + 2] in ("!", "?"):
                end = self.find(">", start)
                return (start, end + 1, "", "", "") if end >= 0 else None
            m = _NAME.match(page, start + 1)
            if m and (end := self.end(m.end())) >= 0:
                return start, end + 1, m[1], m[2].lower(), page[m.end() : end]
            at = start + 1
        return None


def _traits(tag: str, rest: str, within: bool) -> tuple[bool, bool, bool, bool]:
    """(left out, a reader comment, named as the article, doubtful) by the tag's attributes; within: inside an article."""
    if not rest.strip():
        return False, False, False, False
    out = comment = named = doubt = False
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id"):
            own, parts = set(value.split()), set(_PARTS.split(value))
            if within:
                comment |= bool(own & _COMMENTS)
                out |= bool(own & _ASIDE)
                doubt |= bool(parts & _DOUBT)
            else:
                comment |= bool(parts & _COMMENT)
                out |= bool(parts & _BAD) or "header" in own or value in ("site-header", "page-header")
            named |= bool(own & _NAMED)
        elif name == "role":
            out |= value.strip() in _ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out = True
    if tag in ("html", "body"):
        return False, False, False, False
    if tag in _MAIN:
        return comment, comment, False, False
    return out or comment, comment, named, doubt


def blocks(page: str) -> list[tuple[int, str, int, bool, bool]]:
    """(kind, text, element, heading, doubtful) of a page's text blocks in order.

    kind: OUTSIDE, in MAIN, in a NAMED element, or PLAIN; white space is one space.  element: the number of the article
    or main element that the block lies in.  heading: whether it is one.  doubtful: inside an article, under a name that often means something else.
    A header inside an article belongs to it if it holds a heading.
    """
    out: list[tuple] = []
    stack: list[tuple] = []  # tag, left out, in main, in named, in a comment, element, heading, doubtful, header
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    walls: list[int] = []  # where in the stack elements other than inline ones are
    pieces: list[str] = []
    tags, at, state, elements, headers = Tags(page), 0, _START, 0, 0

    def end():
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            out.append((OUTSIDE if state[0] else MAIN if state[1] else NAMED if state[2] else PLAIN, text, *state[4:8]))

    while at < len(page):
        found = tags.next(at)
        if found is None:
            pieces.append(page[at:])
            break
        start, after, closing, tag, rest = found
        pieces.append(page[at:start])
        at = after
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        inline = tag in _INLINE
        if not inline and tag not in _RAW:
            end()
        if closing:
            open_ = places.get(tag)
            if not open_ or inline and walls and walls[-1] > open_[-1]:
                continue  # a stray end; an inline one does not close blocks
            while True:
                last = stack.pop()[0]
                places[last].pop()
                if walls and walls[-1] == len(stack):
                    walls.pop()
                if last == tag:
                    break
            state = stack[-1][1:] if stack else _START
            continue
        if tag in _VOID or rest.endswith("/") and tag not in _OUT | _MAIN:
            continue
        if tag in _RAW:
            stop = _raw_end(tag).search(page, at) if tag not in tags.missing else None
            if stop is None:
                tags.missing.add(tag)
            at = stop.end() if stop else len(page)
            continue
        gone, main, inside, remark, element, heading, doubt, header = state
        left_out, comment, named, unsure = _traits(tag, rest, main or inside)
        if tag == "header" and (main or inside):
            headers += 1
            header = headers
        if tag in _MAIN and not comment and not remark:
            gone, main, elements = left_out, True, elements + 1
            element = elements
        elif tag == "body":
            gone = False
        else:
            gone = gone or left_out or tag in _OUT and not (tag == "header" and (main or inside))
            inside = inside or (named and not gone)
        now = (gone, main, inside, remark or comment, element, heading or tag in _HEADINGS, doubt or unsure, header)
        if now != state and inline:
            end()
        places.setdefault(tag, []).append(len(stack))
        if not inline:
            walls.append(len(stack))
        stack.append((tag, *now))
        state = now
    end()
    titled = {b[5] for b in out if b[3] and b[0] != OUTSIDE} | {0}
    return [(kind if header in titled else OUTSIDE, *rest) for kind, *rest, header in out]


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def contents(page: str) -> tuple[list[list[tuple[str, bool]]], list[str], bool]:
    """(the article's blocks (text, doubtful) by element, other blocks, whether the page says which is which)."""
    found = blocks(page)
    for kind in (MAIN, NAMED):
        if any(b[0] == kind for b in found):
            own: dict[int, list[tuple[str, bool]]] = {}
            for k, text, element, _, doubt in found:
                if k == kind:
                    own.setdefault(element if kind == MAIN else 0, []).append((text, doubt))
            return list(own.values()), [b[1] for b in found if b[0] != kind], True
    return [[(b[1], False) for b in found if b[0] == PLAIN]], [b[1] for b in found if b[0] == OUTSIDE], False


def body(page: str | None) -> str:
    """The article's text without its headings."""
    found = blocks(page or "")
    kind = next((k for k in (MAIN, NAMED) if any(b[0] == k for b in found)), PLAIN)
    return " ".join(b[1] for b in found if b[0] == kind and not b[3])


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each token of the blocks, and how many tokens each block has."""
    digest = xxhash.xxh3_64_intdigest
    own = [list(map(digest, t.split())) for t in texts]
    return np.array([h for x in own for h in x], U64), np.array([len(x) for x in own], np.int64)


def short_blocks(tokens: np.ndarray, count: np.ndarray, size: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(index of each block shorter than a run, its tokens filled up to a run): such a block counts as a run of its own."""
    at = np.flatnonzero((count > 0) & (count < size))
    if not len(at):
        return at, np.zeros((0, size), U64)
    place = (np.cumsum(count) - count)[at][:, None] + np.arange(size)
    return at, np.where(np.arange(size) < count[at][:, None], tokens[np.minimum(place, len(tokens) - 1)], _FILL)


def stream(texts: list[str]) -> np.ndarray:
    """How many blocks are shorter than a run, all tokens of the blocks, those blocks as runs."""
    tokens, count = hashes(texts)
    rows = short_blocks(tokens, count)[1]
    return np.concatenate([np.array([len(rows)], U64), tokens, rows.ravel()])


def parts_of_stream(own: np.ndarray, size: int = RUN) -> list[np.ndarray]:
    cut = len(own) - int(own[0]) * size
    return [own[1:cut], *own[cut:].reshape(-1, size)]


def runs(tokens: np.ndarray, size: int = RUN) -> np.ndarray:
    """The hash of ``size`` tokens from each place on."""
    h = mix(tokens)
    done = 1
    while done < size:
        step = min(done, size - done)
        h = mix(h[:-step] * U64(0x9E3779B97F4A7C15) + h[step:]) if len(h) > step else np.zeros(0, U64)
        done += step
    return h


def suffix_array(tokens: np.ndarray, depth: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order by their first ``depth`` tokens, and their ranks, by prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, done = len(rank), 1
    while done < depth:
        step = min(done, depth - done)
        second = np.full(n, -1, np.int64)
        second[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (n + 2) + second + 1, return_inverse=True)[1].astype(np.int64)
        done += step
    return np.argsort(rank, kind="stable"), rank


def repeated(streams: list[np.ndarray], owner: np.ndarray, size: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(hash of a run of ``size`` tokens, distinct owners that have it) over the suffix array of the concatenated streams; owner: each stream's page."""
    long_enough = [i for i, s in enumerate(streams) if len(s) >= size]
    streams, owner = [streams[i] for i in long_enough], owner[long_enough]
    if not streams:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    # a separator ends each stream; runs that would cross it are left out
    joined = np.concatenate([x for s in streams for x in (s, np.zeros(1, U64))])
    page = np.repeat(np.unique(owner, return_inverse=True)[1], [len(s) + 1 for s in streams])
    left = np.concatenate([np.arange(len(s), -1, -1) for s in streams])
    order, rank = suffix_array(joined, size)
    order = order[left[order] >= size]
    order = order[np.lexsort((page[order], rank[order]))]
    group, own = rank[order], page[order]
    new_group = np.concatenate(([True], group[1:] != group[:-1]))
    new_page = new_group | np.concatenate(([True], own[1:] != own[:-1]))
    heads = np.flatnonzero(new_group)
    stretch = joined[order[heads][:, None] + np.arange(size)[None, :]]
    return _runs_of_rows(stretch), np.add.reduceat(new_page.astype(np.int64), heads)


def _runs_of_rows(rows: np.ndarray) -> np.ndarray:
    h, done, size = mix(rows), 1, rows.shape[1]
    while done < size:
        step = min(done, size - done)
        h = mix(h[:, :-step] * U64(0x9E3779B97F4A7C15) + h[:, step:])
        done += step
    return h[:, 0]


def host_of(url: str | None) -> str:
    m = re.match(r"(?s).*?://([^/?#]*)", url or "")
    return m[1].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if m else ""


def _streams(batches):
    for b in batches:
        rows = []
        for who, url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            own, other, told = contents(page or "")
            alone = told and len(own) == 1
            rows.append((who, host_of(url), stream([t for e in own for t, doubt in e if doubt or not alone] + other).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], ["who", "host", "stream"])


def _shards(batches):
    now, held, owner, out = None, [], [], []

    def close():
        split = [parts_of_stream(np.frombuffer(x, U64)) for x in held]
        code, n = repeated([x for own in split for x in own], np.repeat(np.array(owner, np.int64), [len(own) for own in split]))
        keep = n > 1 if now[2] == 1 else np.ones(len(n), bool)  # a run of a shared host may be on one page of each shard
        host = U64(xxhash.xxh3_64_intdigest(now[0]))
        own = mix(code[keep] ^ host)
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(own), pa.string()), pa.array(own.view(np.int64), pa.int64()), pa.array(n[keep].astype(np.int64), pa.int64())], ["host", "run", "n"])

    for b in batches:
        for *key, who, stream in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != now:
                if now is not None:
                    out.append(close())
                now, held, owner = key, [], []
            if owner and owner[-1] == who and held[-1] == stream:
                continue  # a repeated row
            held.append(stream)
            owner.append(who)
        yield from out
        out = []
    if now is not None:
        yield close()


def _write(folder: str, parts: int):
    def run(batches):
        now, held = None, []

        def close():
            write_array(folder, f"run-{now}", np.sort(np.array(held, np.int64).view(U64)))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(held)], pa.int64())], ["p", "n"])

        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != now:
                    if now is not None:
                        yield close()
                    now, held = p, []
                held.append(x)
        if now is not None:
            yield close()

    return run


class Boilerplate:
    """The hosts' boilerplate runs in sorted arrays, opened by a worker when first needed."""

    def __init__(self, folder: str, parts: int, full: set[int]):
        self.folder, self.parts, self.full, self._open = folder, parts, full, {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _has(self, host: str, code: np.ndarray) -> np.ndarray:
        """Whether each run is boilerplate of the host."""
        hit = np.zeros(len(code), bool)
        if not len(code) or not self.full:
            return hit
        code = mix(code ^ U64(xxhash.xxh3_64_intdigest(host)))
        part = ((code >> U64(33)) % U64(self.parts)).astype(np.int64)
        for p in set(part.tolist()) & self.full:
            if p not in self._open:
                self._open[p] = open_array(self.folder, f"run-{p}")
            own, known = np.flatnonzero(part == p), self._open[p]
            at = np.minimum(np.searchsorted(known, code[own]), len(known) - 1)
            hit[own] = known[at] == code[own]
        return hit

    def covered(self, host: str, texts: list[str]) -> list[np.ndarray]:
        """For each block, whether each of its tokens lies in a boilerplate run of the host."""
        if not self.full:
            return [np.zeros(len(t.split()), bool) for t in texts]
        tokens, count = hashes(texts)
        out = np.zeros(len(tokens), bool)
        hit = self._has(host, runs(tokens))
        for i in range(RUN):
            out[i : i + len(hit)] |= hit
        at, rows = short_blocks(tokens, count)
        by_block = np.split(out, np.cumsum(count)[:-1]) if len(texts) else []
        for i in at[self._has(host, _runs_of_rows(rows))] if len(at) else ():
            by_block[i][:] = True
        return by_block


def boilerplate(pages: DataFrame) -> Boilerplate:
    """Learns the hosts' boilerplate from pages (page_id, url, html).

    Each host's streams of tokens outside the article and of its doubtful blocks (all tokens where a page marks no
    article or several) are dealt to shards of about ``SHARD_PAGES`` pages; a suffix array of each shard, sorted to ``RUN`` tokens, gives its runs and
    their pages; the sums over the shards decide, so a run counts wherever its pages lie.  A token lies in a longer run on
    so many pages exactly if one of the runs of ``RUN`` tokens around it is on so many, so deeper sorting would tell nothing more.  A block of
    fewer tokens is a run of its own, which ends at the block's borders.
    Pages are told apart by page_id, those without one by url and html; a page goes whole to one shard, so repeated
    rows count once.
    """
    spark = prepare(pages.sparkSession)
    who = F.when(F.col("page_id").isNotNull(), F.xxhash64("page_id")).otherwise(F.xxhash64("url", "html"))
    streams = pages.select(who.alias("who"), "url", "html").mapInArrow(_streams, "who bigint, host string, stream binary").where(F.length("stream") > 8 * RUN)
    host = parts_of_url()[0]
    sizes = pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages")).checkpoint()
    few = sizes.count() <= BROADCAST_HOSTS
    near = F.broadcast(sizes) if few else sizes
    shards = F.ceil(F.col("pages") / F.lit(SHARD_PAGES))
    dealt = streams.join(near, "host").select("host", F.pmod("who", shards).alias("shard"), shards.alias("shards"), "who", "stream")
    found = dealt.repartition("host", "shard").sortWithinPartitions("host", "shard", "who").mapInArrow(_shards, "host string, run bigint, n bigint")
    total = found.groupBy("host", "run").agg(F.sum("n").alias("n"))
    own = total.where(F.col("n") >= LEAST_PAGES).select("run").distinct()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = new_folder(spark, "boilerplate")
    part = (F.shiftrightunsigned("run", 33) % parts).cast("int")
    rows = own.select(part.alias("p"), "run").repartition(parts, "p").sortWithinPartitions("p")
    full = {r.p for r in rows.mapInArrow(_write(folder, parts), "p int, n bigint").collect()}
    return Boilerplate(folder, parts, full)


def extract(page: str | None, host: str, known: Boilerplate) -> tuple[str, int]:
    """(main text, tokens of the page that lie in its host's boilerplate).

    Of an unmarked page the blocks outside navigation and the like are taken without the tokens that boilerplate runs
    cover.  Of several marked articles those that runs cover wholly go (teasers that stand on other pages too); a single one
    is kept, as texts and passages of articles are repeated as well, but for its doubtful blocks that runs cover
    wholly.  What leaves nothing gives an empty text.
    """
    own, other, told = contents(page or "")
    n = int(sum(g.sum() for g in known.covered(host, other)))
    if told and len(own) == 1:
        doubtful = [t for t, doubt in own[0] if doubt]
        left_out = [bool(g.all()) for g in known.covered(host, doubtful)] if doubtful else []
        which = iter(left_out)
        n += sum(len(t.split()) for t, gone in zip(doubtful, left_out, strict=True) if gone)
        return " ".join(t for t, doubt in own[0] if not (doubt and next(which))), n
    gone = [known.covered(host, [t for t, _ in e]) for e in own]
    n += int(sum(g.sum() for e in gone for g in e))
    if told:
        kept = [(e, g) for e, g in zip(own, gone, strict=True) if not all(x.all() for x in g)]
        return " ".join(t for e, g in kept for (t, doubt), x in zip(e, g, strict=True) if not (doubt and x.all())), n
    return " ".join(w for (t, _), g in zip(own[0], gone[0], strict=True) for w, x in zip(t.split(), g, strict=True) if not x), n


def main_text(pages: DataFrame) -> DataFrame:
    """For each row of pages (page_id, url, html): page_id, url, text, n_chars and n_boilerplate (tokens in boilerplate runs).

    Null html gives an empty text; a null url belongs to the host ''.  Repeated rows return repeated rows.
    """
    prepare(pages.sparkSession)
    known = boilerplate(pages)
    kind = dict(pages.dtypes)["page_id"]

    def work(batches):
        for b in batches:
            urls = b.column("url").to_pylist()
            made = [extract(page, host_of(url), known) for url, page in zip(urls, b.column("html").to_pylist(), strict=True)]
            cols = [b.column("page_id"), b.column("url"), pa.array([t for t, _ in made], pa.string()), pa.array([len(t) for t, _ in made], pa.int64()), pa.array([n for _, n in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars", "n_boilerplate"])

    return pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {kind}, url string, text string, n_chars bigint, n_boilerplate bigint")


def with_body_hash(pages: DataFrame) -> DataFrame:
    """For each row of pages (page_id, url, html): page_id, url and body_hash, the XXH64 (seed 42) of the article's text without headings; null if that is empty."""
    prepare(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]

    def work(batches):
        for b in batches:
            texts = [body(page) for page in b.column("html").to_pylist()]
            made = [int(np.uint64(xxhash.xxh64_intdigest(t, 42)).view(np.int64)) if t else None for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(made, pa.int64())], ["page_id", "url", "body_hash"])

    return pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {kind}, url string, body_hash bigint")
