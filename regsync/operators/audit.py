"""The second net: matches what the tiers left as new with any registry row, by place or by words of the name."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import dedupe_address, normalize_municipality, split_municipality, with_location, with_parsed_address
from ..functions.base import filled, first_filled, fold, strip, words
from ..functions.keys import state_code
from ..functions.text import core_name, distance_learning
from .classify import address_change, change, name_change, same_or_longer, sequence_changes
from .components import cut, cut_all

# Words of names that tell nothing, and words of public ownership.
GENERIC_WORDS = (
    "escola", "estadual", "municipal", "tecnica", "profissional", "educacao", "centro", "instituto", "colegio", "unidade", "campus", "curso", "cursos", "faculdade",
    "universidade", "sistema", "ensino", "tecnologico", "integrado", "polo", "geral", "rede", "nacional", "distrito", "servico", "social", "aprendizagem", "industrial",
    "comercio", "fundacao", "associacao", "complexo", "grupo", "nucleo",
)
PUBLIC = ("publica", "federal", "estadual", "municipal")


def telling_words(name: Column, muni_norm: Column) -> Column:
    """The name's distinct words of 4 letters or more that are neither generic nor the beginning of the municipality."""
    return F.array_distinct(F.filter(words(fold(F.lower(name))), lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_WORDS) & (w != muni_norm) & ~muni_norm.startswith(w)))


def public(ownership: Column) -> Column:
    """Whether the ownership is public; null if it isn't given."""
    f = fold(ownership)
    return F.when(f != "", f.rlike("|".join(PUBLIC)))


def guards(a: str, b: str) -> Column:
    """The states, the ownership and the mode of teaching must not contradict each other."""
    uf = (F.col(f"{a}.uf2") == "") | (F.col(f"{b}.uf2") == "") | (F.col(f"{a}.uf2") == F.col(f"{b}.uf2"))
    return uf & F.coalesce(F.col(f"{a}.pub") == F.col(f"{b}.pub"), F.lit(True)) & (F.col(f"{a}.ead") == F.col(f"{b}.ead"))


def audit_side(df: DataFrame) -> DataFrame:
    """What the audit compares, from ord, nome, dependencia_adm, uf2, muni_norm, cep_val, num, street and core."""
    return df.select("ord", "uf2", "muni_norm", "cep_val", "num", "street", "core", public(F.col("dependencia_adm")).alias("pub"), distance_learning(F.col("nome")).alias("ead"), telling_words(F.col("nome"), F.col("muni_norm")).alias("words"))


def new_side(fresh: DataFrame) -> DataFrame:
    """The new rows' audit columns, from their cleaned municipality and state; ``placed``, if there, is the address parsed with these."""
    df = fresh.withColumns({"nome": strip(F.col("nome")), "uf2": state_code(F.col("uf"))})
    own = F.col("endereco"), strip(F.col("municipio")), F.col("uf2")
    known = {"known": F.col("placed"), "same": (own[1] == F.col("municipio")) & (F.col("uf2") == F.col("uf"))} if "placed" in fresh.columns else {}
    df = with_location(df, "loc", *own, **known)
    df = df.withColumns({"muni_norm": normalize_municipality(strip(F.col("municipio"))), "core": core_name(F.col("nome"))})
    return audit_side(df.withColumns({"cep_val": F.col("loc.cep"), "num": F.col("loc.num"), "street": F.col("loc.street")}))


#: What the guards compare; a row of x looks at the first registry row of each combination.
_GUARDED = ("uf2", "pub3", "ead")


def _told(df: DataFrame) -> DataFrame:
    """With the ownership as a number, -1 if it isn't given, so that it can be a key."""
    return df.withColumn("pub3", F.coalesce(F.col("pub").cast("int"), F.lit(-1)))


def _firsts(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """(csv_ord, db_ord): for each row of x its first registry row with equal keys that the guards allow.

    Registry rows are reduced to the first of each key and combination of what the guards compare, before they are joined.
    """
    heads = _told(y).groupBy(*keys, *_GUARDED).agg(F.min("ord").alias("ord"), F.first("pub").alias("pub"))
    same = reduce(lambda a, k: a & (F.col(f"x.{k}") == F.col(f"y.{k}")), keys[1:], F.col(f"x.{keys[0]}") == F.col(f"y.{keys[0]}"))
    found = x.alias("x").join(heads.alias("y"), same & guards("x", "y"))
    return found.groupBy(F.col("x.ord").alias("csv_ord")).agg(F.min("y.ord").alias("db_ord"))


def _least(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found).groupBy("csv_ord").agg(F.min("db_ord").alias("db_ord"))


def by_code(x: DataFrame, y: DataFrame) -> DataFrame:
    """(csv_ord, db_ord): the first registry row with the same street-level postal code and no other number."""
    x, y = x.where("cep_val <> ''"), y.where("cep_val <> ''")
    numbered = x.where("num <> ''")
    return _least(_firsts(x.where("num = ''"), y, ["cep_val"]), _firsts(numbered, y, ["cep_val", "num"]), _firsts(numbered, y.where("num = ''"), ["cep_val"]))


def by_street(x: DataFrame, y: DataFrame) -> DataFrame:
    """(csv_ord, db_ord): the first registry row with the same street, number and municipality."""
    own = "street <> '' and num <> ''"
    return _firsts(x.where(own), y.where(own), ["street", "num", "muni_norm"])


def _two_of(name: str) -> Column:
    """All pairs (a, b) of a column's words, sorted."""
    own = F.array_sort(name)
    return F.flatten(F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def by_words(x: DataFrame, y: DataFrame) -> DataFrame:
    """(csv_ord, db_ord): the first registry row of the same municipality with two telling words in common and no clash of numbers.

    Registry rows are reduced by municipality and pair of words: to the first one, and the first with another postal
    code than that (one of the two doesn't clash by its code), and to the first of each code and number.
    """
    open_ = lambda d: d.withColumn("both", F.explode(_two_of("words")))
    keys = ["muni_norm", "both", *_GUARDED]
    own, theirs = open_(x), _told(open_(y)).groupBy(*keys, "cep_val", "num").agg(F.min("ord").alias("ord"), F.first("pub").alias("pub"))
    theirs = cut(theirs)
    codes = theirs.groupBy(*keys, "cep_val").agg(F.min("ord").alias("ord"), F.first("pub").alias("pub"))
    first = codes.groupBy(*keys).agg(F.min(F.struct("ord", "cep_val")).alias("h"), F.first("pub").alias("pub"))
    second = codes.drop("pub").join(first.select(*keys, "h"), keys).where("cep_val <> h.cep_val").groupBy(*keys).agg(F.min("ord").alias("next"))
    heads = first.join(second, keys, "left")
    on = (F.col("x.muni_norm") == F.col("y.muni_norm")) & (F.col("x.both") == F.col("y.both")) & guards("x", "y")
    free = (F.col("x.cep_val") == "") | (F.col("x.num") == "") | (F.col("y.h.cep_val") != F.col("x.cep_val"))
    other = own.alias("x").join(heads.alias("y"), on).select(F.col("x.ord").alias("csv_ord"), F.when(free, F.col("y.h.ord")).otherwise(F.col("next")).alias("db_ord"))
    numbered = own.where("cep_val <> '' and num <> ''")
    same = on & (F.col("x.cep_val") == F.col("y.cep_val"))
    near = [numbered.alias("x").join(d.alias("y"), c).select(F.col("x.ord").alias("csv_ord"), F.col("y.ord").alias("db_ord")) for d, c in ((theirs.where("num = ''"), same), (theirs, same & (F.col("x.num") == F.col("y.num"))))]
    return _least(other.where("db_ord is not null"), *near)


#: Rows of either side of a municipality and pair of words that one unit of work compares; more are dealt over several units.
SLICE = 3_000
#: Candidate pairs of one task, about, and the most tasks that they are dealt over; candidate pairs and rows that a task holds at once.
TASK_PAIRS, MOST_TASKS, HELD_PAIRS, HELD_ROWS = 10_000_000, 20_000, 1 << 19, 20_000


def _numbers(texts: pa.Array) -> np.ndarray:
    """A number for each text, 0 for empty ones and nulls."""
    coded = texts.dictionary_encode()
    known = coded.dictionary.to_pylist()
    own = np.array([0 if not w else i + 1 for i, w in enumerate(known)] + [0], np.int32)
    return own[coded.indices.fill_null(len(known)).to_numpy(zero_copy_only=False)]


def _whole_units(batches):
    """Tables of whole units, many at a time; the input is sorted by unit."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.num_rows
        if total < HELD_ROWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(total, bool)
        for name in ("g", "i", "j"):
            own = t[name].to_numpy()
            last &= own == own[-1]
        cut_at = total - int(last.sum())
        if cut_at:
            yield t.slice(0, cut_at)
        held = t.slice(cut_at).to_batches()
        total -= cut_at
    if total:
        yield pa.Table.from_batches(held)


def _compared(batches):
    """Rows (csv_ord, db_ords) of the pairs of each unit (g, i, j) that fit; input sorted by unit, new rows (side 0) before the registry's."""
    for t in _whole_units(batches):
        g, i, j, side, ord_ = (t[n].to_numpy() for n in ("g", "i", "j", "side", "ord"))
        unit = np.concatenate(([0], np.cumsum((g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        theirs = np.bincount(unit, side, int(unit[-1]) + 1).astype(np.int64)
        after = np.cumsum(np.bincount(unit))
        before = t["before"].combine_chunks()
        length = np.diff(before.offsets.to_numpy())
        words = np.full((t.num_rows, max(1, int(length.max()))), -1, np.int64)
        row = np.repeat(np.arange(t.num_rows), length)
        flat = _numbers(before.flatten())
        words[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = flat
        marks = np.zeros(t.num_rows, np.uint64)
        np.bitwise_or.at(marks, row, np.uint64(1) << (flat % 64).astype(np.uint64))
        uf, code, num = (_numbers(t[n].combine_chunks()) for n in ("uf2", "cep_val", "num"))
        pub = t["pub"].to_numpy()
        told = [v for v in (uf, pub) if len(np.unique(v)) > 1]
        own = np.flatnonzero(side == 0)
        count = theirs[unit[own]]
        start, ends = after[unit[own]] - count, np.cumsum(count)
        a = 0
        while a < len(own):
            done = int(ends[a - 1]) if a else 0
            z = max(a + 1, int(np.searchsorted(ends, done + HELD_PAIRS, side="right")))
            n = count[a:z]
            x = np.repeat(own[a:z], n)
            y = np.arange(len(x)) + np.repeat(start[a:z] - (ends[a:z] - n - done), n)
            ok = (marks[x] & marks[y]) == 0
            doubt = np.flatnonzero(~ok)  # a mark in common: the words are compared
            left, right = words[x[doubt]], words[y[doubt]]
            shared = np.zeros(len(doubt), bool)
            for w in range(words.shape[1]):
                shared |= ((left == right[:, w : w + 1]) & (left >= 0)).any(axis=1)
            ok[doubt] = ~shared
            for v in told:
                p, q = v[x], v[y]
                ok &= (p == q) | (p == 0) | (q == 0)
            near = code[x]
            near = np.flatnonzero((near == code[y]) & (near != 0))  # the same street-level postal code: another number is a clash
            p, q = num[x[near]], num[y[near]]
            ok[near[(p != 0) & (q != 0) & (p != q)]] = False
            ends_ok = np.concatenate(([0], np.cumsum(ok)))[np.concatenate(([0], ends[a:z] - done))]
            found = pa.ListArray.from_arrays(pa.array(ends_ok, pa.int32()), pa.array(ord_[y[ok]]))
            yield pa.RecordBatch.from_arrays([pa.array(ord_[own[a:z]]), found], ["csv_ord", "db_ords"])
            a = z


def pairs_by_words(x: DataFrame, y: DataFrame) -> DataFrame:
    """(csv_ord, db_ord): all pairs that ``by_words`` takes the first of, each once.

    Rows meet by municipality, mode of teaching and pair of words, and count at the first pair of words that they share, so
    nothing is to be made distinct: no other word up to the pair's second one may be common.  A unit of work holds about
    ``SLICE`` rows of either side, and tasks grow in number with the pairs, which grow with the square of a municipality's rows.
    """
    c, keys = F.col, ["muni_norm", "both", "ead"]

    def open_(d):
        d = d.withColumn("words", F.array_sort("words")).withColumn("both", F.explode(_two_of("words")))
        before = F.filter("words", lambda w: (w < c("both.b")) & (w != c("both.a")))
        pub = F.when(c("pub").isNull(), 0).when(c("pub"), 1).otherwise(2)
        return d.select(*keys, c("ord").cast("long").alias("ord"), "uf2", pub.alias("pub"), "cep_val", "num", before.alias("before"))

    sides = [open_(x), open_(y)]
    counts = [d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in zip(sides, ("n_i", "n_j"), strict=True)]
    groups = cut(counts[0].join(counts[1], keys).withColumn("g", F.monotonically_increasing_id()))
    pairs = groups.agg(F.sum(c("n_i").cast("double") * c("n_j"))).first()[0] or 0
    tasks = max(x.sparkSession.sparkContext.defaultParallelism, min(int(pairs // TASK_PAIRS), MOST_TASKS))
    groups = groups.select(*keys, "g", *[F.ceil(c(n) / SLICE).cast("int").alias(n) for n in ("n_i", "n_j")])

    def dealt(d, side, own, other):
        d = d.join(groups, keys).withColumn(own, F.pmod(F.xxhash64("ord"), c(f"n_{own}")).cast("int"))
        d = d.withColumn(other, F.explode(F.sequence(F.lit(0), c(f"n_{other}") - 1)))
        return d.select("g", "i", "j", F.lit(side).alias("side"), "ord", "uf2", "pub", "cep_val", "num", "before")

    rows = dealt(sides[0], 0, "i", "j").unionByName(dealt(sides[1], 1, "j", "i"))
    rows = rows.repartition(tasks, "g", "i", "j").sortWithinPartitions("g", "i", "j", "side")
    return rows.mapInArrow(_compared, "csv_ord bigint, db_ords array<bigint>").select("csv_ord", F.explode("db_ords").alias("db_ord"))


def by_core(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs whose core name only one registry row has; nothing guards them."""
    sole = y.where(F.length("core") >= 5).groupBy("core").agg(F.min("ord").alias("db_ord"), F.count("*").alias("n")).where("n = 1")
    return x.select(F.col("ord").alias("csv_ord"), "core").join(sole, "core").select("csv_ord", "db_ord")


def audit_match(x: DataFrame, y: DataFrame) -> DataFrame:
    """(csv_ord, db_ord): for each new row the first registry row by code, street or words, else the one with its core name.

    Equi-joins in place of a nested loop; registry rows may be found again.
    """
    first = _least(by_code(x, y), by_street(x, y), by_words(x, y))
    rest = x.join(first.select(F.col("csv_ord").alias("ord")), "ord", "left_anti")
    return first.unionByName(by_core(rest, y))


def audit(fresh: DataFrame, registry: DataFrame) -> DataFrame:
    """The rescued rows of ``fresh`` (status novo) with their new status, id and differences."""
    c = F.col
    found = cut(audit_match(*cut_all(new_side(fresh), audit_side(registry))))
    db = registry.select(c("ord").alias("db_ord"), *[c(n).alias(f"d_{n}") for n in ("id", "nome", "municipio", "endereco", "uf", "cep", "cursos")])
    df = fresh.drop("db_ord", "tier").join(found.withColumnRenamed("csv_ord", "ord"), "ord").join(db, "db_ord")
    df = df.withColumns({"n_uf": state_code(c("uf")), "s": split_municipality(first_filled(strip(c("municipio")), c("d_municipio"))), "uf_old": strip(c("d_uf")), "cep_old": strip(c("d_cep"))})
    df = with_parsed_address(df, "p", c("endereco"), c("s.muni"), c("n_uf"))
    town = c("p.municipio")
    df = df.withColumns(
        {
            "m": F.when(filled(town).isNotNull() & ~same_or_longer(c("s.muni"), town), town).otherwise(c("s.muni")),
            "u": first_filled(c("p.uf"), c("n_uf"), c("s.uf")),
            "c": first_filled(c("p.cep"), c("s.cep")),
        }
    )
    first = [
        F.when(name_change(c("nome"), c("d_nome")), change("nome_instituicao", c("d_nome"), c("nome"))),
        F.when((c("m") != "") & (fold(c("m")) != fold(c("d_municipio"))), change("municipio", c("d_municipio"), c("m"))),
    ]
    last = F.when(address_change(dedupe_address(c("endereco")), dedupe_address(c("d_endereco")), contained=False), change("endereco", c("d_endereco"), c("endereco")))
    df = sequence_changes(df, "u", "c", "uf_old", "cep_old", first, last)
    changed = F.size("diferencas") > 0
    return df.select(
        F.when(changed, "alterado").otherwise("mantido").alias("status"), "ord", c("d_id").alias("id"), "nome", c("m").alias("municipio"), c("u").alias("uf"), c("c").alias("cep"), "endereco",
        F.when(changed, c("d_endereco")).alias("endereco_db"), "diferencas", "dependencia_adm", "telefone", "email", "homepage", "cursos", c("d_nome").alias("nome_db"), c("d_cursos").alias("cursos_db"), "db_ord", F.lit(9).cast("long").alias("tier"),
    )
