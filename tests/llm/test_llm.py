"""The text operators against brute force, exact round trips and held-out labels, with nulls, ties and empty tables."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from regsync.llm import bytecnn, common, cube, fm, kneser, ordermin, ordinal, pages, simhash, urls, wumanber

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, fp int"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "één twee"), (5, "same text here again"), (5, "same text here again"), (6, "same text here again"), (None, "no id at all"), (7, "word " * 30_000), (8, "🙂" * 50)]


def documents(spark, rows=ODD):
    """With a column whose name an operator uses itself."""
    return spark.createDataFrame([(i, t, "en" if t else None, "s" if t else None, 0) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# 1
def test_order_minhash(spark):
    got = ordermin.fingerprints(documents(spark), range_chars=2000).collect()
    order = sorted(ODD, key=lambda r: -(r[0] if r[0] is not None else -(2**63)))
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD)
    by_id = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(order):
        if i == 5:
            continue
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        r = by_id[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), ordermin.as_text(ordermin.fingerprint(t)), ordermin.as_text(ordermin.fingerprint(new)))
    assert by_id[1].fingerprint == "0" * 512 and by_id[6].near_next == 1
    assert ordermin.fingerprints(documents(spark, [])).count() == 0
    alone = ordermin.fingerprints(documents(spark, [(9, "abcdef")])).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_order_minhash_heeds_order():
    rng = random.Random(1)
    a = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(300))
    w = a.split()
    moved = " ".join(w[150:] + w[:150])
    other = " ".join("".join(rng.choices("klmnopqrst", k=6)) for _ in range(300))
    f = ordermin.fingerprint
    assert ordermin.likeness(f(a), f(moved)) < 0.8 and ordermin.likeness(f(a), f(a + " x")) > 0.9 and ordermin.likeness(f(a), f(other)) < 0.05
    x = ordermin.kmers("abababababababab")
    assert len(x) == 9 and len(set(x.tolist())) == 9  # repeats are numbered


# 2
PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>H</header><nav><a>Home</a></nav><div id="cookie-notice">Cookies</div>
<article><h1>T&eacute;st &amp; more</h1><p>One<b>two</b>&nbsp; three<br>four <script>if(a<b){}</script></p><p>Five<ul><li>six<li>seven</ul><form><input><label>Mail</label></form>
<aside>Related</aside><div class="ad">Buy</div><section class="comments"><article class="comment"><p>First!</p></article></section></article><footer>(c)</footer></body></html>"""


def test_html():
    known = pages.Boilerplate("", 1, set())
    assert pages.extract(PAGE, "h", known)[0] == "Tést & more Onetwo three four Five six seven"
    assert pages.body(PAGE) == "Onetwo three four Five six seven"
    assert pages.extract(None, "", known) == ("", 0) and pages.extract("plain <words", "", known)[0].startswith("plain")
    assert pages.extract('<div class="content"><p>a</p></div><div>b</div>', "", known)[0] == "a"
    assert pages.extract("<p>a<b>b</p></b> c</i> <a title='x>y'>d</a> <a title=\"e>f</p>", "", known)[0] == "ab c d f"


def test_hostile_pages_take_linear_time():
    def seconds(page):
        start = time.perf_counter()
        pages.blocks(page)
        return time.perf_counter() - start

    for piece in ("<a \"", "<div>", "</div><b>", "<div><b></div", "</i><i>", "<", "<!--", "<a '\">", "<script>", "<b x=\"'"):
        assert seconds(piece * 40_000) < 8 * seconds(piece * 10_000) + 0.5, piece


def naive_text(rows):
    """The texts by brute force: per host all runs of RUN tokens, and all blocks of fewer, with the distinct pages that have them."""
    seen = {}
    split = lambda texts: [w for t in texts for w in t.split()]
    parsed = [(k, i, pages.host_of(u), pages.contents(h or "")) for k, (i, u, h) in enumerate(rows)]

    def pieces(host, texts):
        words = split(texts)
        for j in range(len(words) - pages.RUN + 1):
            yield (host, "run", *words[j : j + pages.RUN]), j, pages.RUN
        j = 0
        for t in texts:
            n = len(t.split())
            if 0 < n < pages.RUN:
                yield (host, "block", *t.split()), j, n
            j += n

    for k, i, host, (own, other, told) in parsed:
        for key, _, _ in pieces(host, [t for e in own for t, doubt in e if doubt or not (told and len(own) == 1)] + other):
            seen.setdefault(key, set()).add(i if i is not None else ("row", rows[k][1], rows[k][2]))
    often = {key for key, who in seen.items() if len(who) >= pages.LEAST_PAGES}

    def covered(host, texts):
        hit = [False] * len(split(texts))
        for key, j, n in pieces(host, texts):
            if key in often:
                hit[j : j + n] = [True] * n
        out, j = [], 0
        for t in texts:
            out.append(hit[j : j + len(t.split())])
            j += len(t.split())
        return out

    out = []
    for _, i, host, (own, _, told) in parsed:
        text = []
        for e in own:
            single = told and len(own) == 1  # then only the doubtful blocks are looked at
            found = iter(covered(host, [t for t, doubt in e if doubt or not single]))
            hits = [next(found) if doubt or not single else [False] * len(t.split()) for t, doubt in e]
            if told and len(own) > 1 and all(all(h) for h in hits):
                continue
            for (t, doubt), h in zip(e, hits, strict=True):
                text += [w for w, x in zip(t.split(), h, strict=True) if not x] if not told else [] if doubt and all(h) else [t]
        out.append((i, " ".join(text)))
    return out


def test_html_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(60)}"
    notices = [" ".join(word() for _ in range(rng.randrange(6, 30))) for _ in range(6)]
    rows = []
    for i in range(60):
        unique = " ".join(f"u{i}-{k}" for k in range(rng.randrange(0, 40)))
        notice, teaser = rng.choice(notices), rng.choice(notices)
        page = rng.choice([f"<div>{notice}</div><p>{unique}</p><div>{teaser} {unique}</div>", f"<main><article>{unique}</article><article>{teaser}</article></main><p>{notice}</p>", f"<article>{teaser} {unique}</article><p>{notice}</p>", f"<p>{notice} {notice}</p>",
            f"<div>Home About us</div><p>{unique}</p><p>{word()} {word()}</p>", f"<article><p class='share-price'>{teaser}</p><div id='reply-{i}'>{unique}</div><p class='form'>{word()}</p></article>"])
        rows += [(i if i % 9 else None, f"http://h{i % 3}.test/{i}", page)] * rng.randrange(1, 4)
    rows += [(500, None, None), (501, "http://h1.test", ""), (1, "http://h1.test/1", "<p>another page with one id</p>")]
    monkeypatch.setattr(pages, "SHARD_PAGES", 20)
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    order = lambda pairs: sorted(pairs, key=str)
    assert order((r.page_id, r.text) for r in got) == order(naive_text(rows))


def test_suffix_array():
    rng = random.Random(2)
    streams = [np.array([rng.randrange(1, 4) for _ in range(40)], np.uint64) for _ in range(6)]
    order, rank = pages.suffix_array(streams[0], 8)
    tails = [tuple(streams[0][i : i + 8].tolist()) for i in range(40)]
    assert [tails[i] for i in order] == sorted(tails)
    owner = [0, 1, 0, 2, 2, 3]
    code, n = pages.repeated(streams, np.array(owner), 5)
    brute = {}
    for s, who in zip(streams, owner, strict=True):
        for i in range(len(s) - 4):
            brute.setdefault(tuple(s[i : i + 5].tolist()), set()).add(who)
    assert sorted(n.tolist()) == sorted(len(x) for x in brute.values()) and len(set(code.tolist())) == len(brute)


def test_boilerplate_of_unmarked_pages(spark):
    shared = "this long notice stands on every single page of the host"
    rows = [(i, "http://A.example/x", f"<div>{shared}</div><p>n{i} alpha beta gamma delta{i}</p>") for i in range(8)] + [(99, None, None), (100, "nothing", "<p>x</p>"), (100, "nothing", "<p>x</p>")]
    rows += [(200, "http://B.example/x", f"<p>{shared}</p>")] * 4 + [(201, "http://B.example/y", f"<p>{shared}</p><p>more</p>")]
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"n{i} alpha beta gamma delta{i}" for i in range(8))
    assert got[99].text == "" and got[99].n_chars == 0 and got[100].text == "x"
    assert got[201].text == f"{shared} more"  # two distinct pages only, whatever rows repeat
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 3 and 4
def _held_out(spark, table_label):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    truth = {r.doc_id: r[table_label] for r in labels.collect()}
    return docs, labels, truth


def test_quality(spark):
    docs, labels, truth = _held_out(spark, "quality")
    model = fm.train(docs, labels.where(common.remainder("doc_id", 5) != 0))
    got = fm.quality_scores(docs.where(common.remainder("doc_id", 5) == 0), model, ["doc_id"]).collect()
    pairs = [(truth[r.doc_id], r.score >= 0.3) for r in got if r.doc_id in truth]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.95
    odd = fm.quality_scores(documents(spark), model, ["doc_id"]).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    blank = fm.train(docs.limit(0), labels.limit(0))
    assert fm.quality_scores(docs.limit(0), blank, ["doc_id"]).count() == 0
    kept = fm.keep_good(documents(spark), labels.limit(0))
    assert kept.columns == documents(spark).columns


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = fm.FactorisationMachine(size=16, factors=3)
    model.w, model.v = rng.standard_normal(model.total).astype(np.float32), rng.standard_normal((model.total, 3)).astype(np.float32)
    index, value, stats = np.array([1, 5, 9]), np.array([0.5, 0.2, 0.7], np.float32), rng.standard_normal((1, len(model.mean))).astype(np.float32)
    x = np.zeros(model.total)
    x[index], x[16:] = value, np.clip(stats[0], -4, 4)
    pairwise = sum(float(model.v[i] @ model.v[j]) * x[i] * x[j] for i in range(model.total) for j in range(i))
    got = model.raw(np.zeros(3, int), index, value, stats, 1)[0][0]
    assert got == pytest.approx(float(model.w @ x) + pairwise, rel=1e-3)


def test_toxicity(spark):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        own = rng.choices(plain, k=60)
        bad = i % 5 == 0
        for _ in range(rng.randrange(1, 9) if bad else 0):
            own[rng.randrange(60)] = rng.choice(["vile", "nasty", "awful"])
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = ordinal.train(docs, marks.where("doc_id % 3 <> 0"))
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in ordinal.severity(docs.where("doc_id % 3 = 0"), model, ["doc_id"]).collect()}
    assert sum((r.toxic_score >= 0.3) == (i % 5 == 0) for i, r in got.items()) / len(got) > 0.95
    few, many = (model.score([t.encode()])[0][0] for t in ("vile w1 w2", "vile nasty awful vile nasty w1"))
    assert 0 <= few < many <= 3
    assert len(ordinal.severity(documents(spark), model, ["doc_id"]).collect()) == len(ODD)
    assert ordinal.severity(docs.limit(0), ordinal.train(docs.limit(0), marks.limit(0)), ["doc_id"]).count() == 0


# 5
def test_simhash_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(12)} | set(base)
    # a crowd that shares half its bits and is close in many ways
    prints |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(0, 32, 3) for j in range(0, 32, 5)}
    monkeypatch.setattr(simhash, "LARGE", 10)
    signed = [p - (p >> 63 << 64) for p in prints]
    roots = {r.node: r.root for r in simhash.connected_components(simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {s: roots.get(s, s) for s in signed} == {s: find(s) for s in signed}


def test_simhash_documents(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    for i, t in ODD:
        w = words(t)
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert by_id[i].fp & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert by_id[1].component_id == by_id[3].component_id == 1 and by_id[6].component_id == 5 and by_id[None].component_id is None
    kept = simhash.deduplicate(documents(spark))
    assert kept.columns == documents(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "7", "8", "None"]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


# 6
def test_urls(spark):
    rows = [(1, "HTTP://A.NET/x?q"), (2, "http://en.example.net/en/1"), (3, "http://example.com/de/1"), (4, "http://q.example.org/fr/1#z"), (5, None), (6, "no scheme"), (7, "http://x.test"), (7, "http://x.test")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.net", "/x", "net/", "block")
    assert (got[2].rule, got[2].verdict, got[3].rule, got[3].verdict, got[4].rule, got[4].path) == ("example.net/en/", "allow", "example.com/de/", "block", "org/fr/", "/fr/1")
    assert got[5].host == got[6].host == got[5].path == "" and got[7].path == "" and got[5].verdict == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def naive_templates(shapes):
    """The tree by recursion: {shape: template}, shapes {segments: (n, labelled, bad)}."""
    out = {}

    def purity(rows):
        return (sum(shapes[s][2] for s in rows) + urls.PRIOR * urls.STRENGTH) / (sum(shapes[s][1] for s in rows) + urls.STRENGTH)

    def walk(members, level, template):
        children = {}
        for s in members:
            if level < len(s):
                children.setdefault(s[level], []).append(s)
            else:
                out[s] = template
        total = sum(shapes[s][0] for rows in children.values() for s in rows)
        many = len(children) >= urls.CHILDREN and len(children) >= urls.VARIETY * total
        families = {}
        for name, rows in children.items():
            n, following = sum(shapes[s][0] for s in rows), Counter()
            for s in rows:
                following[s[level + 1] if level + 1 < len(s) else "/"] += shapes[s][0]
            shares = tuple(sorted((k, math.floor(c / n * urls.STEPS + 0.5)) for k, c in following.items() if c / n >= 1 / urls.HEAVY))
            families.setdefault((shares, purity(rows) >= urls.REJECT), []).append(name)
        parts = {}
        for names in families.values():
            for name in names:
                label = "*" if many else f"{min(names)}~" if len(names) > 1 else name
                parts.setdefault(label, []).extend(children[name])
        for label, rows in parts.items():
            walk(rows, level + 1, f"{template}/{label}")

    walk(list(shapes), 0, "")
    return out


def test_urls_against_a_plain_tree(spark):
    """Hosts whose good and bad branches no word of the URL tells apart."""
    rng = random.Random(6)
    rows = []
    for i in range(900):
        section = rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"])
        path = rng.choice([f"/{section}/{i}", f"/{section}/x{i}y/view", f"/{section}/{rng.choice(['a', 'b', 'c'])}/{rng.choice(['p', 'q'])}", f"/s{i}"])
        bad = None if rng.random() < 0.6 else rng.random() < (0.9 if section in ("beta", "delta") else 0.05)
        rows.append((i, f"http://host{i % 2}.test{path}", bad))
    judged = urls.judge(spark.createDataFrame(rows, "page_id long, url string, bad boolean"))
    got = {r.page_id: r for r in judged.collect()}
    seg = {r.page_id: tuple(r.s) for r in spark.createDataFrame(rows, "page_id long, url string, bad boolean").select("page_id", urls.segments(urls.parts()[1]).alias("s")).collect()}
    for host in ("host0.test", "host1.test"):
        own = [r for r in rows if got[r[0]].host == host]
        shapes = {}
        for i, _, bad in own:
            n, labelled, b = shapes.get(seg[i], (0, 0, 0))
            shapes[seg[i]] = (n + 1, labelled + (bad is not None), b + bool(bad))
        templates = naive_templates(shapes)
        sums = {}
        for s, t in templates.items():
            labelled, b = sums.get(t, (0, 0))
            sums[t] = (labelled + shapes[s][1], b + shapes[s][2])
        above = {}
        for t, (labelled, b) in sums.items():
            for depth in range(1, t.count("/") + 2):
                up = "/".join(t.split("/")[:depth])
                above[up] = tuple(x + y for x, y in zip(above.get(up, (0, 0)), (labelled, b), strict=True))
        share = lambda x, expected: (x[1] + urls.STRENGTH * expected) / (x[0] + urls.STRENGTH)
        known = [bad for _, _, bad in rows if bad is not None]
        for i, _, _ in own:
            t = templates[seg[i]]
            purity = share((len(known), sum(known)), urls.PRIOR)
            for depth in range(1, t.count("/") + 2):
                purity = share(above["/".join(t.split("/")[:depth])], purity)
            assert (got[i].template, got[i].verdict) == (templates[seg[i]], "block" if purity >= urls.REJECT else "allow")
            assert got[i].purity == pytest.approx(purity)
        assert {got[i].verdict for i, _, _ in own} == {"allow", "block"}
    assert any(r.template.endswith("~/<n>") or "~/" in r.template for r in got.values())


def test_few_labels_of_a_large_template_decide_nothing(spark):
    rows = [(i, f"http://h.test/a/{i}", True if i == 5 else None) for i in range(1000)]
    rows += [(2000 + i, f"http://g.test/b/{i}", i > 2) for i in range(40)] + [(3000 + i, f"http://g.test/b/c{i}/x", None) for i in range(3)] + [(4000 + i, f"http://g.test/d/{i}", False) for i in range(100)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, bad boolean")).collect()}
    assert {got[i].verdict for i in range(1000)} == {"allow"} and {got[2000 + i].verdict for i in range(40)} == {"block"}
    assert {got[3000 + i].verdict for i in range(3)} == {"block"}  # no label of its own: as its parent
    assert {got[4000 + i].verdict for i in range(100)} == {"allow"}
    free = urls.judge(spark.createDataFrame(rows, "page_id long, url string, bad boolean").drop("bad")).collect()
    assert {r.verdict for r in free} == {"allow"} and all(r.purity == pytest.approx(urls.PRIOR) for r in free)


def test_page_labels(spark):
    docs = spark.createDataFrame([(1, "good  text here"), (2, "bad text here"), (3, "bad text here"), (4, "no label"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    html = [(10, "u", "<article><h1>T</h1><p>good text</p><p>here</p></article>"), (11, "u", "<article>bad text here</article>"), (12, None, "<p>no label</p>"), (12, None, None)]
    shown = pages.with_body_hash(spark.createDataFrame(html, "page_id long, url string, html string"))
    assert sorted((r.page_id, str(r.bad)) for r in urls.page_labels(shown, docs, labels).collect()) == [(10, "False"), (11, "True"), (12, "None"), (12, "None")]


# 7
def test_kneser_ney_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(200)]
    rows = ODD + [(1000 + i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(120)]
    docs = documents(spark, rows)
    train = [(i, t) for i, t in rows if i is not None and i % 3]
    model = kneser.train(docs.where("doc_id % 3 <> 0"), partition_chars=3000)
    tokens = lambda t: [*words(t), "</s>"]
    single, triple = Counter(), Counter()
    for _, t in train:
        x = tokens(t)
        single.update(x)
        triple.update(zip(["<s>", "<s>", *x], ["<s>", *x], x, strict=False))
    n, v = sum(single.values()), len(single)
    of = lambda d, c: 0 if c == 0 else d[min(c, 3) - 1]
    found = lambda counts: kneser.discounts([list(counts.values()).count(k) for k in (1, 2, 3, 4)])
    pair = Counter()
    for (a, b, c), k in triple.items():
        pair[(b, c)] += k if a == b == "<s>" else 1
    before = Counter(b for _, b in pair)
    d1, d2, d3 = found(before), found(pair), found(triple)
    kinds = len(pair)
    spare = sum(of(d1, c) for c in before.values()) / kinds

    def summed(counts, d):
        total, kept = Counter(), Counter()
        for key, c in counts.items():
            total[key[:-1]] += c
            kept[key[:-1]] += of(d, c)
        return total, kept

    total2, kept2 = summed(pair, d2)
    total3, kept3 = summed(triple, d3)
    p1 = lambda w: (before[w] - of(d1, before[w])) / kinds + spare / (v + 1)
    p2 = lambda b, w: p1(w) if not total2[(b,)] else (pair[(b, w)] - of(d2, pair[(b, w)]) + kept2[(b,)] * p1(w)) / total2[(b,)]

    def p(a, b, w):
        if not total3[(a, b)]:
            return p2(b, w)
        return (triple[(a, b, w)] - of(d3, triple[(a, b, w)]) + kept3[(a, b)] * p2(b, w)) / total3[(a, b)]

    for a, b in (("w1", "w2"), ("<s>", "<s>"), ("<s>", "w1"), ("never", "w1")):
        assert sum(p(a, b, w) for w in single) + p(a, b, "never seen") == pytest.approx(1)
    got = kneser.perplexity(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        x, r = tokens(t), by_id[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(single[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((single[w] + 1) / (n + v + 1)) for w in x))
        assert r.score == pytest.approx(sum(math.log10(p(a, b, w)) for a, b, w in zip(["<s>", "<s>", *x], ["<s>", *x], x, strict=False)))
    none = kneser.train(documents(spark, []))
    assert kneser.perplexity(documents(spark), none, ["doc_id"]).count() == len(ODD)


# 8
def test_wu_manber_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(8)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([3, 5, 13, 13, 14, 20, 1, 2, 7, 9, 16])] + [(50, None), (51, " .,"), (None, "v1 v2"), (2, "V1-v2!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = ODD + [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randrange(80))) + " " + (items[5][1] if i % 4 == 0 else "")) for i in range(40)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for most in (1_000_000, 20):  # one index, and several
        got = wumanber.contamination(documents(spark, rows).select("doc_id", "text", "fp"), bench, index_words=most).collect()
        assert len(got) == len(rows)
        by_id = {r.doc_id: r for r in got}
        for i, t in rows:
            w, hit, found = split(t), set(), set()
            for item, text in items:
                b = split(text)
                size = min(13, len(b))
                if item is None or not b or len(w) > 1000:
                    continue
                for k in range(len(b) - size + 1):
                    for j in range(len(w) - size + 1):
                        if w[j : j + size] == b[k : k + size]:
                            hit |= set(range(j, j + size))
                            found.add(str(item))
            assert (by_id[i].n_words, by_id[i].n_hit, by_id[i].items) == (len(w), len(hit), sorted(found))
    clean = wumanber.decontaminate(documents(spark), bench)
    assert clean.columns == documents(spark).columns
    assert wumanber.contamination(documents(spark), bench.limit(0)).where("n_hit > 0").count() == 0
    assert wumanber.contamination(documents(spark, []), bench).count() == 0


# 9
def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    model = bytecnn.train(docs, common.remainder("doc_id", 4) != 2)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = bytecnn.languages(docs.where(common.remainder("doc_id", 4) == 2), model, ["doc_id"]).collect()
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) / len(got) > 0.97
    odd = {r.doc_id: r for r in bytecnn.languages(documents(spark), model, ["doc_id"]).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[8].lang_pred == "und" and odd[7].lang_pred in model.classes
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert bytecnn.languages(docs.limit(0), bytecnn.train(docs.limit(0)), ["doc_id"]).count() == 0
    long = bytes(range(97, 123)) * 400
    assert (bytecnn.spread_windows(long, 10**6) == bytecnn.windows(long)).all() and len(bytecnn.spread_windows(long, 5)) == 5
    whole, few = bytecnn.windows(long), bytecnn.spread_windows(long, 7)
    assert (few == whole[np.linspace(0, len(whole) - 1, 7).round().astype(int)]).all()  # from the first to the last
    assert bytecnn.windows(b"A" * 400).shape == (3, bytecnn.LENGTH) and bytecnn.windows(b"").shape == (1, bytecnn.LENGTH)


def test_the_network_learns_by_its_gradient(spark):
    """One step of Adam moves each weight by the sign of the loss's slope, taken by differences."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(97, 103, (64, bytecnn.LENGTH)).astype(np.uint8), rng.integers(0, 3, 64)
    model = bytecnn.ByteCNN(["a", "b", "c"])

    def loss(m):
        z = m.logits(x).astype(float)
        z -= z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(64), y]))

    slopes = {}
    for name, at in (("out", (3, 1)), ("out_bias", (2,)), ("bias", (7,)), ("filters", (5, 20)), ("embed", (99, 4))):
        own, d = getattr(model, name), 3e-3
        keep = own[at]
        own[at] = keep + d
        up = loss(model)
        own[at] = keep - d
        slopes[name, at] = (up - loss(model)) / (2 * d)
        own[at] = keep
    before = {k: getattr(model, k[0])[k[1]] for k in slopes}
    model.fit(x, y, rounds=1, batch=64)
    for (name, at), slope in slopes.items():
        moved = getattr(model, name)[at] - before[name, at]
        assert abs(slope) < 1e-4 or np.sign(moved) == -np.sign(slope), (name, slope, moved)


# 10
def test_targets_and_sample(spark):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randrange(1, 40), None, ["b", "a", None, "Z"][min(i % 7, 3)], 0) for i in range(400)] + [(None, None, None, "a", 0), (900, "w w", None, "a", 0), (900, "w w", None, "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        level = (goal - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2 * sizes[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    got = cube.mixture(docs, block=32).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, _, s, _ in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in sizes)
    again = cube.mixture(docs.repartition(3), block=32).collect()
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in again)
    assert cube.mixture(docs.limit(0)).count() == 0


def test_flight_keeps_the_balance():
    rng = np.random.default_rng(1)
    prob, traits = rng.random(500), np.column_stack([rng.integers(1, 90, 500), np.ones(500)]).astype(float)
    out = cube.flight(prob, traits, 3)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2 and np.allclose(out @ traits, prob @ traits)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_dedup", "decontamination", "mixing"]
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(out) < docs.count() and len({r.doc_id for r in out}) == len(out)


def test_the_rest_does_not_import_this():
    import pathlib

    root = pathlib.Path(common.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"\bllm\b", p.read_text())]
