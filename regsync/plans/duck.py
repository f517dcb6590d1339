"""The same semantics as DuckDB SQL text, against which queries are held."""

from __future__ import annotations

from functools import reduce

from .. import domain
from ..functions import address as A
from ..functions import text as X
from ..functions.keys import TIERS
from ..operators import audit as AU


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pattern(p: str) -> str:
    return q(p.replace("(?iU)", "(?i)").replace("(?U)", ""))


def sub(x: str, p: str, new: str = "") -> str:
    return f"regexp_replace({x}, {_pattern(p)}, {q(new)}, 'g')"


def like(x: str, p: str) -> str:
    return f"regexp_matches({x}, {_pattern(p)})"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def marks(x: str) -> str:
    return f"trim({x}, '.,;- ')"


def seps(x: str) -> str:
    return strip(sub(x, r"[\s,/|-]+$"))


def text(x: str) -> str:
    return f"coalesce({x}, '')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def let(x: str, name: str, body: str) -> str:
    return f"list_transform([{x}], lambda {name}: {body})[1]"


def fold(x: str) -> str:
    return sub(f"strip_accents(lower({strip(text(x))}))", r"[^a-z0-9\s]", " ")


def listed(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def expand(x: str) -> str:
    return f"trim({sub(reduce(lambda t, r: sub(t, *r), X.ABBREVIATIONS, fold(x)), '[ \\t\\n\\r]+', ' ')})"


def distance(x: str) -> str:
    return f"({like(f'lower({text(x)})', X.DISTANCE)} OR contains({fold(x)}, 'a distancia'))"


def richness(x: str) -> str:
    score = f"CASE WHEN w IN {listed(X.RICHNESS_ACRONYMS)} THEN -2 WHEN length(w) >= 5 THEN 3 ELSE 1 END"
    return f"CAST(greatest(coalesce(list_sum(list_transform(list_filter({words(fold(x))}, lambda w: length(w) >= 3), lambda w: {score})), 0), 0) AS INTEGER)"


def core(x: str) -> str:
    out = reduce(lambda t, p: sub(t, rf"\b{p}\b", " "), X.GENERIC_PHRASES, expand(x))
    return sub(sub(sub(out, X.SUFFIXES, " "), X.PLACES, " "), "[^a-z0-9]")


def tokens(x: str) -> str:
    return f"array_to_string(list_sort(list_filter({words(expand(x))}, lambda w: length(w) >= 3 AND w NOT IN {listed(X.TOKEN_STOPS)})), '_')"


def muni_norm(x: str) -> str:
    out = sub(sub(sub(f"translate({fold(x)}, 'zjy', 'sgi')", "ss", "s"), "eo$", "eu"), "aes$", "ais")
    kept = f"list_filter({words(out)}, lambda w: w NOT IN {listed(A.MUNICIPALITY_STOPS)} AND NOT {like('w', '^[0-9]+$')})"
    return sub(f"array_to_string({kept}, '')", "[^a-z]")


def natural_key(name: str, norm: str, uf: str) -> str:
    held = f"list_filter([{expand(name)}, {norm}, substring(upper({fold(uf)}), 1, 2)], lambda p: p <> '')"
    joined = f"array_to_string({held}, '_')"
    return sub(f"{strip(joined)} || CASE WHEN {distance(name)} THEN '_ead' ELSE '' END", "[^a-z0-9_]")


def pedagogical(x: str) -> str:
    return fold(strip(sub(reduce(lambda t, p: sub(t, p, " "), X.PEDAGOGICAL, sub(f"lower({text(x)})", r"[\-/,]", " ")), r"\s+", " ")))


def cep_text(x: str) -> str:
    return seps(marks(strip(text(x))))


def cep_of(t: str) -> str:
    return f"nullif({sub(f'regexp_extract({t}, {_pattern(A.CEP_AT_END)}, 1)', '[^0-9]')}, '')"


def without_cep(t: str) -> str:
    return seps(marks(strip(sub(strip(sub(t, A.CEP_AT_END)), A.CEP_ANYWHERE))))


_UF = "|".join(A.UFS)


def has_uf(t: str) -> str:
    return like(t, rf"(?i)\S\s+(?:{_UF})$")


def drop_uf(t: str) -> str:
    cut = f"regexp_replace({t}, '(?i)(\\S)\\s+(?:{_UF})$', '\\1')"
    return f"CASE WHEN {has_uf(t)} THEN {strip(sub(cut, r'[ \t\n\r]+', ' '))} ELSE {t} END"


def last_uf(t: str) -> str:
    return f"nullif(upper(regexp_extract({t}, '(?i)\\S\\s+({_UF})$', 1)), '')"


def split_base(x: str) -> str:
    return seps(without_cep(cep_text(seps(strip(text(x))))))


def muni_clean(x: str) -> str:
    return let(split_base(x), "mb", strip(sub(seps(drop_uf("mb")), r"^\d+\s*,\s*")))


def muni_uf(x: str) -> str:
    return let(split_base(x), "mb", last_uf("mb"))


def muni_cep(x: str) -> str:
    return cep_of(cep_text(seps(strip(text(x)))))


def is_muni(x: str) -> str:
    return f"NOT {like(sub(f'lower({strip(text(x))})', r'\s+', ' '), A._NEVER)}"


def protect(a: str, b: str) -> str:
    x, y = f"trim({fold(a)})", f"trim({fold(b)})"
    return f"CASE WHEN coalesce({a}, '') = '' THEN {b} WHEN coalesce({b}, '') = '' THEN {a} WHEN {x} = {y} OR (length({x}) > length({y}) AND starts_with({x}, {y})) THEN {a} ELSE {b} END"


def dedupe(x: str) -> str:
    out = sub(text(x), A.POST_BOX)
    for p, kind in A.STREET_KINDS:
        out = sub(out, "(?i)" + p, kind)
    parts = f"list_filter(list_transform(string_split({out}, ','), lambda p: {strip('p')}), lambda p: p <> '')"
    kept = let(parts, "ps", "list_filter(ps, lambda p, i: list_position(list_transform(ps, lambda z: lower(z)), lower(p)) = i)")
    return strip(sub(f"array_to_string({kept}, ', ')", r"\s+", " "))


def parse_ctes(source: str, name: str, address: str, muni: str, uf: str) -> str:
    """CTEs that end in ``name``: all columns of ``source`` and p_logradouro ... p_cep."""
    s = lambda i: f"{name}_{i}"
    found = f"upper(regexp_extract(t, {_pattern(A.UF_AT_END)}, 1))"
    last = f"list_transform([parts[len(parts)]], lambda z: {muni_clean(fold('z'))})[1]"
    n = "len(parts)"
    out = [
        f"{s(1)} AS (SELECT *, CASE WHEN coalesce({muni}, '') <> '' THEN {muni_clean(muni)} END AS m, CASE WHEN length({strip(text(uf))}) >= 2 THEN upper(substring({strip(text(uf))}, 1, 2)) END AS u, {strip(text(address))} AS raw FROM {source})",
        f"{s(2)} AS (SELECT *, u AS u0, CASE WHEN {is_muni('m')} THEN nullif(m, '') END AS town, raw = '' OR lower(raw) = 'não informado' AS blank, {cep_text(dedupe(marks('raw')))} AS t0 FROM {s(1)})",
        f"{s(3)} AS (SELECT * EXCLUDE (t0), {cep_of('t0')} AS cep_, {without_cep('t0')} AS t FROM {s(2)})",
        f"{s(4)} AS (SELECT * REPLACE (coalesce(u, CASE WHEN {found} IN {listed(A.UFS)} THEN {found} END) AS u, CASE WHEN u IS NULL AND {found} IN {listed(A.UFS)} THEN {marks(strip(sub('t', A.UF_AT_END)))} ELSE t END AS t) FROM {s(3)})",
        f"{s(5)} AS (SELECT * REPLACE (coalesce(u, {last_uf('t')}) AS u, CASE WHEN u IS NULL AND {has_uf('t')} THEN {marks(drop_uf('t'))} ELSE t END AS t) FROM {s(4)})",
        f"{s(6)} AS (SELECT * REPLACE (CASE WHEN {has_uf('t')} THEN {marks(drop_uf('t'))} ELSE t END AS t) FROM {s(5)})",
        f"{s(7)} AS (SELECT *, list_filter(list_transform(string_split(t, ','), lambda p: {strip('p')}), lambda p: p <> '') AS parts FROM {s(6)})",
        f"{s(8)} AS (SELECT *, town AS town0, list_filter(list_transform(list_reverse(parts), lambda p: {muni_clean('p')}), lambda p: {is_muni('p')})[1] AS chosen FROM {s(7)})",
        f"{s(9)} AS (SELECT * REPLACE (CASE WHEN chosen IS NOT NULL THEN {protect('town', 'chosen')} ELSE town END AS town) FROM {s(8)})",
        f"{s(10)} AS (SELECT *, {last} AS lastc, {muni_clean(fold('town'))} AS mine FROM {s(9)})",
        f"{s(11)} AS (SELECT * REPLACE (CASE WHEN len(parts) > 0 AND coalesce(town, '') <> '' AND (lastc = mine OR starts_with(mine, lastc)) THEN parts[1:len(parts) - 1] ELSE parts END AS parts) FROM {s(10)})",
        f"{name} AS (SELECT * EXCLUDE (m, u, raw, u0, town, blank, cep_, t, parts, town0, chosen, lastc, mine), CASE WHEN NOT blank THEN parts[1] END AS p_logradouro, CASE WHEN NOT blank THEN parts[2] END AS p_numero, "
        f"CASE WHEN NOT blank AND {n} >= 4 THEN array_to_string(parts[3:{n} - 1], ', ') END AS p_complemento, CASE WHEN NOT blank AND {n} = 3 THEN parts[3] WHEN NOT blank AND {n} >= 4 THEN parts[{n}] END AS p_bairro, "
        f"CASE WHEN blank THEN town0 ELSE town END AS p_municipio, CASE WHEN blank THEN u0 ELSE u END AS p_uf, CASE WHEN NOT blank THEN cep_ END AS p_cep FROM {s(11)})",
    ]
    return ",\n".join(out)


def location_ctes(source: str, name: str, address: str, muni: str, uf: str) -> str:
    """CTEs that end in ``name``: the columns of parse_ctes and l_cep, l_num, l_street."""
    blank = f"lower({strip(text(address))}) IN {listed(('', *A.BLANKS))}"
    number = strip(text("p_numero"))
    digits = sub(number, "[^0-9]")
    street = fold(text("p_logradouro"))
    kind = A._STREET_KIND
    return (
        parse_ctes(source, f"{name}_p", address, muni, uf)
        + f""",
{name} AS (SELECT *, CASE WHEN {blank} OR {text('p_cep')} LIKE '%000' OR length({text('p_cep')}) <> 8 THEN '' ELSE p_cep END AS l_cep,
CASE WHEN {blank} THEN '' WHEN {digits} <> '' THEN {digits} WHEN lower({number}) IN {listed(A.NO_NUMBER)} THEN 'sn' ELSE '' END AS l_num,
CASE WHEN {blank} THEN '' WHEN {like(street, kind)} THEN {strip(sub(street, kind))} ELSE {street} END AS l_street FROM {name}_p)"""
    )


def _names(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


REG = f"""reg AS (
SELECT c_custkey AS id, 'E.E. Prof. ' || c_name AS nome_instituicao, {_names(domain.MUNICIPALITIES)}[n_nationkey % 25 + 1] AS municipio, {_names(domain.STATES)}[n_regionkey % 5 + 1] AS uf,
  lpad(CAST(10000001 + 37 * c_custkey AS VARCHAR), 8, '0') AS cep,
  'Rua das Flores, ' || c_custkey || ', Centro, ' || {_names(domain.MUNICIPALITIES)}[n_nationkey % 25 + 1] || ' ' || {_names(domain.STATES)}[n_regionkey % 5 + 1] || ' - ' || lpad(CAST(10000001 + 37 * c_custkey AS VARCHAR), 8, '0') AS endereco,
  CAST(c_custkey % 13 <> 0 AS INTEGER) AS ativo
FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

BAT = f"""bat AS (
SELECT id AS pos, CASE WHEN id % 10 = 1 THEN replace(nome_instituicao, 'E.E. Prof. ', 'Escola Estadual Professor ') ELSE nome_instituicao END AS nome_instituicao,
  CASE WHEN id % 10 = 3 THEN municipio || ' ' || uf || ' - ' || cep ELSE municipio END AS municipio, uf,
  CASE WHEN id % 10 = 2 THEN 'Avenida Nova Esperança, ' || id || ', Bairro Novo, ' || municipio || ' ' || uf || ' - ' || cep WHEN id % 10 = 4 THEN 'Rua das Flores, Centro, ' || municipio || ' ' || uf || ' - ' || cep ELSE endereco END AS endereco
FROM reg WHERE id % 10 <> 0
UNION ALL
SELECT s_suppkey + 10000000, 'Centro de Treinamento ' || s_name, {_names(domain.MUNICIPALITIES)}[s_nationkey % 25 + 1], {_names(domain.STATES)}[CAST(s_suppkey % 5 AS INTEGER) + 1],
  'Travessa do Porto, ' || (s_suppkey + 500000) || ', Cais, ' || {_names(domain.MUNICIPALITIES)}[s_nationkey % 25 + 1] || ' ' || {_names(domain.STATES)}[CAST(s_suppkey % 5 AS INTEGER) + 1]
FROM supplier)"""


def _joined(parts, condition: str) -> str:
    """The parts joined by underscores where all are filled and the condition holds."""
    filled = " AND ".join([*(x + " <> ''" for x in parts), condition])
    return f"CASE WHEN {filled} THEN " + " || '_' || ".join(parts) + " END"


TIERED = """bat AS (
SELECT id AS pos, CASE WHEN k = 1 THEN 'Colégio ' || n WHEN k = 3 THEN replace(n, 'E.E. Prof. ', '') || ' Prof. E.E.' WHEN k IN (4, 5, 9) THEN 'Liceu Novo ' || id ELSE n END AS nome_instituicao, m AS municipio, u AS uf,
  CASE WHEN k IN (0, 7) THEN e WHEN k = 9 THEN 'Beco Torto, ' || (id + 700000) || ', Centro, ' || m || ' ' || u WHEN k = 5 THEN 'Rua das Flores, ' || id || ', Centro, ' || m || ' ' || u ELSE 'Rua das Flores, ' || id || ', Centro, ' || m || ' ' || u || ' - ' || cep END AS endereco
FROM (SELECT r.id, r.id % 10 AS k, r.cep, coalesce(f.nome_instituicao, r.nome_instituicao) AS n, CASE WHEN r.id % 10 IN (2, 6) THEN 'Xique Xique' ELSE coalesce(f.municipio, r.municipio) END AS m, CASE WHEN r.id % 10 = 6 THEN 'AM' ELSE coalesce(f.uf, r.uf) END AS u, coalesce(f.endereco, r.endereco) AS e
  FROM reg r LEFT JOIN reg f ON r.id % 10 = 7 AND f.id = r.id - 7 WHERE r.id % 10 <> 7 OR f.id IS NOT NULL))"""


HARD = TIERED.replace("bat AS (", "tiered AS (", 1) + """, bat AS (FROM tiered UNION ALL
SELECT id + 1000000, CASE WHEN k = 0 THEN 'Casa Azul ' || id WHEN k = 1 THEN 'Casa Verde ' || id WHEN k = 2 THEN 'Predio ' || replace(nome_instituicao, 'E.E. ', '') ELSE before END,
  CASE WHEN k = 3 THEN 'Xique Xique' ELSE municipio END, CASE WHEN k = 3 THEN 'AM' WHEN k = 0 THEN uf ELSE '' END,
  CASE WHEN k = 0 THEN 'Beco Curto, Centro, ' || municipio || ' ' || uf || ' - ' || cep WHEN k = 1 THEN 'Rua das Flores, ' || id || ', Centro, ' || municipio ELSE '' END
FROM (SELECT r.*, (r.id // 10) % 4 AS k, p.nome_instituicao AS before FROM reg r LEFT JOIN reg p ON p.id = r.id - 1 WHERE r.id % 10 = 9))"""


def greedy_ctes(keys: str) -> str:
    """CTEs that end in ``g``: csv_ord, db_ord and tier by the sequential procedure, one batch row after the other, over rk and bk of ``keys``."""
    names = [f"k{i}" for i in range(1, 8)]
    heads = ", ".join(f"h{i} AS (SELECT {k} AS k, list(ord ORDER BY ord) AS l FROM rk WHERE {k} IS NOT NULL GROUP BY {k})" for i, k in enumerate(names, 1))
    joins = " ".join(f"LEFT JOIN h{i} ON h{i}.k = b.{k}" for i, k in enumerate(names, 1))
    queue = f"queue AS MATERIALIZED (SELECT row_number() OVER (ORDER BY b.ord) AS i, CAST(b.ord AS BIGINT) AS ord, k2 IS NOT NULL AS has2, {', '.join(f'CAST(h{i}.l AS BIGINT[]) AS l{i}' for i in range(1, 8))} FROM bk b {joins})"
    free = ", ".join(f"list_filter(l{i}, lambda x: NOT list_contains(taken, x)) AS f{i}" for i in range(1, 8))
    fits = [f"len(f{i}) = 1" if policy == "sole" else f"len(f{i}) >= 1" for i, (_, policy) in enumerate(TIERS, 1)]
    again = "CASE WHEN l1 IS NOT NULL THEN l1[1] WHEN has2 THEN l2[1] ELSE l5[1] END"
    found = "CASE " + " ".join(f"WHEN {fit} THEN f{i}[1]" for i, fit in enumerate(fits, 1)) + f" ELSE {again} END"
    tier = "CASE " + " ".join(f"WHEN {fit} THEN {i}" for i, fit in enumerate(fits, 1)) + f" WHEN {again} IS NOT NULL THEN 8 END"
    step = f"SELECT i, ord, found, CAST(tier AS BIGINT), CASE WHEN found IS NULL THEN taken ELSE list_append(taken, found) END FROM (SELECT i, ord, taken, {found} AS found, {tier} AS tier FROM (SELECT q.*, g.taken, {free} FROM g JOIN queue q ON q.i = g.i + 1))"
    return f"RECURSIVE {keys}, {heads}, {queue}, g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS csv_ord, CAST(NULL AS BIGINT) AS db_ord, CAST(NULL AS BIGINT) AS tier, CAST([] AS BIGINT[]) AS taken UNION ALL {step})"


def keys_ctes(reg: str = REG, bat: str = BAT) -> str:
    """CTEs rk and bk: ord, nome, endereco, muni, uf2, muni_norm, core, tokens, cep_val, num, street and k1 to k7 of both sides."""

    def side(name, source, order, state):
        split = f"{name}_s AS (SELECT {order} AS ord, nome_instituicao AS nome, endereco, municipio, {'ativo' if name == 'rk' else '1'} AS ativo, uf, {muni_clean('municipio')} AS muni0, coalesce(nullif({state}, ''), {muni_uf('municipio')}, '') AS kuf, coalesce({muni_cep('municipio')}, '') AS ext_cep FROM {source})"
        if name == "bk":
            parsed = parse_ctes(f"{name}_s", f"{name}_a", "endereco", "muni0", "kuf")
            a, b = fold("p_municipio"), fold("muni0")
            better = f"coalesce(p_municipio, '') <> '' AND (muni0 = '' OR length({a}) > length({b}) OR starts_with({a}, {b}))"
            town = f"{name}_t AS (SELECT ord, nome, endereco, municipio, ativo, uf, ext_cep, CASE WHEN {better} THEN p_municipio ELSE muni0 END AS muni, coalesce(nullif(kuf, ''), p_uf, '') AS kuf FROM {name}_a)"
        else:
            parsed = f"{name}_a AS (SELECT * FROM {name}_s)"
            town = f"{name}_t AS (SELECT ord, nome, endereco, municipio, ativo, uf, ext_cep, muni0 AS muni, kuf FROM {name}_a)"
        coded = f"{name}_u AS (SELECT *, {'kuf' if name == 'bk' else f'substring(upper({fold("kuf")}), 1, 2)'} AS uf2 FROM {name}_t)"
        located = location_ctes(f"{name}_u", f"{name}_l", "endereco", "muni", "uf2")
        made = f"{name}_m AS (SELECT *, {muni_norm('muni')} AS muni_norm, {core('nome')} AS core, {tokens('nome')} AS tokens, coalesce(nullif(l_cep, ''), ext_cep) AS cep_val FROM {name}_l)"
        k = lambda cond, *p: _joined(p, cond)
        keyed = (
            f"{name} AS (SELECT *, nullif({natural_key('nome', 'muni_norm', 'kuf')}, '') AS k1, {k('true', 'core', 'muni_norm', 'uf2')} AS k2, {k('length(core) >= 5', 'core', 'uf2')} AS k3, {k('length(tokens) >= 6', 'tokens', 'uf2')} AS k4, "
            f"{k('true', 'cep_val', 'l_num', 'uf2')} AS k5, {k('true', 'l_street', 'l_num', 'muni_norm', 'uf2')} AS k6, {k('length(core) >= 5', 'core')} AS k7 FROM {name}_m)"
        )
        return ",\n".join([split, parsed, town, coded, located, made, keyed])

    return ",\n".join([reg, bat, side("rk", "reg", "id", "uf"), side("bk", "bat", "pos", f"substring(upper({fold('uf')}), 1, 2)")])


def telling(name: str, norm: str) -> str:
    return f"list_distinct(list_filter({words(fold(f'lower({name})'))}, lambda w: length(w) >= 4 AND w NOT IN {listed(AU.GENERIC_WORDS)} AND w <> {norm} AND NOT starts_with({norm}, w)))"


def change(name: str, old: str, new: str) -> str:
    said = [q(f"{name}: '"), old, q("' ➔ '"), new, q("'")]
    return " || ".join(said)


AUDIT_GUARD = "x.ead = y.ead AND (x.uf2 = '' OR y.uf2 = '' OR x.uf2 = y.uf2) AND NOT (x.cep <> '' AND x.cep = y.cep AND x.num <> '' AND y.num <> '' AND x.num <> y.num)"


def audit_ctes(source: str) -> str:
    """CTEs x and y, what the audit compares, of ``source`` (rows of bk) and rk; and af and ac, the first registry row by place or words, and by core name."""
    first = lambda name, on: f"{name} AS (SELECT x.ord AS csv_ord, min(y.ord) AS db_ord FROM x JOIN y ON {on} AND {AUDIT_GUARD} GROUP BY x.ord)"
    return ", ".join(
        [
            f"xs AS (SELECT ord, nome, muni AS am, kuf AS au, endereco AS ae FROM {source}), {location_ctes('xs', 'xl', 'ae', 'am', f'substring(upper({fold("au")}), 1, 2)')}",
            f"x AS (SELECT ord, substring(upper({fold('au')}), 1, 2) AS uf2, {muni_norm('am')} AS muni_norm, {core('nome')} AS core, l_cep AS cep, l_num AS num, l_street AS street, {distance('nome')} AS ead, {telling('nome', muni_norm('am'))} AS w FROM xl)",
            f"y AS (SELECT ord, uf2, muni_norm, core, cep_val AS cep, l_num AS num, l_street AS street, {distance('nome')} AS ead, {telling('nome', 'muni_norm')} AS w FROM rk)",
            first("a_cep", "x.cep = y.cep AND x.cep <> ''"),
            first("a_street", "x.street = y.street AND x.num = y.num AND x.muni_norm = y.muni_norm AND x.street <> '' AND x.num <> ''"),
            first("a_words", "x.muni_norm = y.muni_norm AND len(list_intersect(x.w, y.w)) >= 2"),
            "a_core AS (SELECT x.ord AS csv_ord, db_ord FROM x JOIN (SELECT core, min(ord) AS db_ord FROM y WHERE length(core) >= 5 GROUP BY core HAVING count(*) = 1) USING (core))",
            "af AS (SELECT csv_ord, min(db_ord) AS db_ord FROM (FROM a_cep UNION ALL FROM a_street UNION ALL FROM a_words) GROUP BY csv_ord)",
            "au AS (FROM af UNION ALL SELECT csv_ord, db_ord FROM a_core WHERE csv_ord NOT IN (SELECT csv_ord FROM af))",
        ]
    )


def _rescued() -> str:
    """CTEs that end in ``saved``: ord, id, status and diferencas of the new rows that the audit finds."""
    f = fold
    given = "coalesce(nullif(b.muni, ''), r.municipio)"
    joined = f"rj AS (SELECT b.ord, b.nome, b.endereco, r.ord AS id, r.nome AS d_nome, r.endereco AS d_endereco, r.municipio AS d_municipio, r.uf AS d_uf, reg.cep AS d_cep, {muni_clean(given)} AS s_muni, {muni_uf(given)} AS s_uf, {muni_cep(given)} AS s_cep, substring(upper({f('b.kuf')}), 1, 2) AS n_uf FROM au JOIN bk b ON b.ord = csv_ord JOIN rk r ON r.ord = db_ord JOIN reg ON reg.id = r.ord)"
    keep = f"({f('s_muni')} = {f('p_municipio')} OR (length({f('s_muni')}) > length({f('p_municipio')}) AND starts_with({f('s_muni')}, {f('p_municipio')})))"
    values = f"rv AS (SELECT *, CASE WHEN coalesce(p_municipio, '') <> '' AND NOT {keep} THEN p_municipio ELSE s_muni END AS m, coalesce(nullif(p_uf, ''), nullif(n_uf, ''), s_uf, '') AS u, coalesce(nullif(p_cep, ''), s_cep, '') AS cc FROM rp)"
    d1 = f"CASE WHEN {f('nome')} <> {f('d_nome')} AND {richness('nome')} > {richness('d_nome')} THEN {change('nome_instituicao', 'd_nome', 'nome')} END"
    d2 = f"CASE WHEN m <> '' AND {f('m')} <> {f('d_municipio')} THEN {change('municipio', 'd_municipio', 'm')} END"
    d3 = f"CASE WHEN u <> '' AND d_uf <> '' AND substring({f('u')}, 1, 2) <> substring({f('d_uf')}, 1, 2) THEN {change('uf', 'd_uf', 'u')} END"
    d4 = f"CASE WHEN cc <> '' AND d_cep <> '' AND cc <> d_cep THEN {change('cep', 'd_cep', 'cc')} END"
    new, old = f(dedupe("endereco")), f(dedupe("d_endereco"))
    d5 = f"CASE WHEN {new} <> '' AND {old} <> '' AND {new} <> {old} AND length({new}) >= CAST(floor(length({old}) * 0.8) AS INTEGER) THEN {change('endereco', 'd_endereco', 'endereco')} END"
    saved = f"saved AS (SELECT ord, id, CASE WHEN len(d) > 0 THEN 'alterado' ELSE 'mantido' END AS status, array_to_string(d, ' | ') AS diferencas FROM (SELECT *, list_filter([{d1}, {d2}, {d3}, {d4}, {d5}], lambda x: x IS NOT NULL) AS d FROM rv))"
    return ",\n".join([joined, parse_ctes("rj", "rp", "endereco", "s_muni", "n_uf"), values, saved])


def diff_ctes(hard: bool = False) -> str:
    """CTEs that end in ``diff``: ord, id, status, diferencas (joined by ' | ').

    The plain batch needs the natural key only, which is unique there; ``hard`` is the batch that needs all tiers, matched by
    the sequential procedure, and the audit.
    """
    new, old = dedupe(strip("endereco")), dedupe(strip("d_endereco"))
    f = fold
    joined = (
        "j AS (SELECT b.ord, b.nome, b.endereco, b.muni, b.kuf, b.cep_val, b.ext_cep, substring(upper(" + f("b.uf") + "), 1, 2) AS uf_given, r.ord AS id, r.nome AS d_nome, r.endereco AS d_endereco, r.municipio AS d_municipio, r.uf AS d_uf, r.ativo AS d_ativo FROM bk b JOIN pairs ON b.ord = csv_ord JOIN rk r ON r.ord = db_ord)"
    )
    parsed = parse_ctes("j", "jp", "endereco", "muni", "uf_given")
    keep = f"({f('muni')} = {f('p_municipio')} OR (length({f('muni')}) > length({f('p_municipio')}) AND starts_with({f('muni')}, {f('p_municipio')})))"
    values = f"jv AS (SELECT *, CASE WHEN coalesce(p_municipio, '') <> '' AND NOT {keep} THEN p_municipio ELSE muni END AS m, coalesce(nullif(p_uf, ''), kuf) AS u, coalesce(nullif(p_cep, ''), nullif(cep_val, ''), ext_cep, '') AS cc, {new} AS e_new, {old} AS e_old FROM jp)"
    d1 = f"CASE WHEN {f('nome')} <> {f('d_nome')} AND {richness('nome')} > {richness('d_nome')} THEN {change('nome_instituicao', 'd_nome', 'nome')} END"
    d2 = f"CASE WHEN m <> '' AND {f('m')} <> {f('d_municipio')} THEN {change('municipio', 'd_municipio', 'm')} END"
    first = f"jd AS (SELECT *, list_filter([{d1}, {d2}], lambda x: x IS NOT NULL) AS d FROM jv)"
    d3 = f"CASE WHEN u <> '' AND d_uf <> '' AND substring({f('u')}, 1, 2) <> substring({f('d_uf')}, 1, 2) THEN {change('uf', 'd_uf', 'u')} END"
    second = f"je AS (SELECT * REPLACE (CASE WHEN {d3} IS NOT NULL THEN list_append(d, {d3}) ELSE d END AS d) FROM jd)"
    third = f"jf AS (SELECT * REPLACE (CASE WHEN cc <> '' AND len(d) > 0 THEN list_append(d, {change('cep', q(''), 'cc')}) ELSE d END AS d) FROM je)"
    d5 = f"{f('e_new')} <> '' AND {f('e_old')} <> '' AND {f('e_new')} <> {f('e_old')} AND NOT contains({f('e_old')}, {f('e_new')}) AND length(e_new) >= CAST(floor(length(e_old) * 0.8) AS INTEGER)"
    fourth = f"jg AS (SELECT * REPLACE (CASE WHEN {d5} THEN list_append(d, {change('endereco', 'e_old', 'e_new')}) ELSE d END AS d) FROM jf)"
    status = (
        "diff AS (SELECT ord, id, CASE WHEN d_ativo = 0 THEN 'reativado' WHEN len(d) > 0 THEN 'alterado' ELSE 'mantido' END AS status, CASE WHEN d_ativo = 0 THEN '' ELSE array_to_string(d, ' | ') END AS diferencas FROM jg "
        + ("UNION ALL FROM saved " if hard else "")
        + "UNION ALL SELECT ord, NULL, 'novo', '' FROM nv"
        + (" WHERE ord NOT IN (SELECT ord FROM saved)" if hard else "")
        + " UNION ALL SELECT NULL, ord, 'inativado', '' FROM rk WHERE ativo = 1 AND ord NOT IN (SELECT db_ord FROM pairs))"
    )
    fresh = "nv AS (SELECT * FROM bk WHERE ord NOT IN (SELECT csv_ord FROM pairs))"
    if hard:
        keys = f"{greedy_ctes(keys_ctes(REG, HARD))}, pairs AS (SELECT csv_ord, db_ord FROM g WHERE db_ord IS NOT NULL), {fresh}, {audit_ctes('nv')}, {_rescued()}"
    else:
        keys = f"{keys_ctes()}, pairs AS (SELECT b.ord AS csv_ord, r.ord AS db_ord FROM bk b JOIN rk r ON b.k1 = r.k1), {fresh}"
    return ",\n".join([keys, joined, parsed, values, first, second, third, fourth, status])


def statement(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"

