"""Brazilian postal codes, municipalities and free-text addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import built_once, filled, fold, let, lit, rstrip_separators, strip, strip_marks, sub, words

# States, Roman numerals, and what can't be a municipality.
UFS = ("AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO")
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX")
NOT_MUNICIPALITY_STARTS = (
    "rua", "avenida", "av", "travessa", "trv", "praça", "pça", "alameda", "rodovia", "rod", "quadra", "qda", "setor", "st", "lote", "lt", "bloco", "bl",
    "apartamento", "apto", "sala", "sl", "sn", "s/n", "centro", "bairro", "distrito", "parque", "pq", "km", "nº", "no", "n",
)
NEIGHBOURHOODS = (
    "jardim america", "jardim botanico", "jardim paulista", "jardim eldorado", "jardim iguacu", "jardim europa", "jardim alvorada", "jardim primavera", "jardim esperanca",
    "jardim sao paulo", "jardim da penha", "jardim novo", "jardim lindo", "jardim belo", "jardim das flores", "jardim dos ipes", "jd america", "jd botanico", "jd paulista", "jd eldorado", "jd iguacu",
)
MUNICIPALITY_STOPS = ("de", "do", "da", "dos", "das", "e", *(u.lower() for u in UFS))
STREET_STARTS = ("rua ", "avenida ", "av ", "travessa ", "trv ", "praça ", "pça ", "alameda ", "rodovia ", "rod ")
BLANKS = ("não informado", "n/i", "none")
NO_NUMBER = ("s/n", "sn", "sem numero", "sem número", "0", "00")

# Patterns of postal codes, post boxes, units, trailing states, and abbreviated street kinds.
CEP_AT_END = r"(?iU)(?:[-\s,/|-]+)(?:CEP\s*:?\s*)?(\d{2}\.\d{3}[-\.]?\d{2,3}|\d{5}[-\.]?\d{1,3}|\d{5,8})\s*[-.]*$"
CEP_ANYWHERE = r"(?U)\b\d{2}\.\d{3}[-\.]?\d{2,3}\b|\b\d{5}-?\d{1,3}\b"
POST_BOX = r"(?iU)\b(?:Cx\.?\s*postal|Caixa\s*postal|C\.?\s*P\.?)\s*[-:]?\s*[\d\.\-]*\b(?:\s*CEP\s*[-:]?\s*\d{5}-?\d{3})?"
UNIT = r"(?U)^(sl|sala|setor|qda|quadra|lote|bloco|apto)\s*[-:]?\s*\d*"
UF_AT_END = r"(?iU)(?:[\s,/|-]+)([A-Z]{2})\b\s*[-:]?$"
STREET_KINDS = ((r"\bEnida\b", "Avenida"), (r"\bAv\.\b|\bAv\b", "Avenida"), (r"\bR\.\b", "Rua"), (r"\bAl\.\b", "Alameda"), (r"\bPco\.\b", "Praça"))

PARTS = ("logradouro", "numero", "complemento", "bairro", "municipio", "uf", "cep")


def _cep_text(text: Column) -> Column:
    return rstrip_separators(strip_marks(strip(F.coalesce(text, lit("")))))


def _cep_of(t: Column) -> Column:
    return filled(sub(F.regexp_extract(t, CEP_AT_END, 1), r"\D"))


def _without_cep(t: Column) -> Column:
    return rstrip_separators(strip_marks(strip(sub(strip(sub(t, CEP_AT_END)), CEP_ANYWHERE))))


def extract_cep(text: Column) -> Column:
    """struct(cep, text): the postal code's digits at the end or null, and the text without any postal code."""
    t = _cep_text(text)
    return F.struct(_cep_of(t).alias("cep"), _without_cep(t).alias("text"))


def format_cep(cep: Column) -> Column:
    """#####-### for eight digits, else the digits."""
    return let(sub(F.coalesce(cep, lit("")), r"\D"), lambda d: F.when(F.length(d) == 8, F.concat(F.substring(d, 1, 5), F.lit("-"), F.substring(d, 6, 3))).otherwise(d))


def is_cep(cep: Column) -> Column:
    return F.length(sub(F.coalesce(cep, lit("")), r"\D")).between(5, 8)


def is_roman(word: Column) -> Column:
    return F.coalesce(F.upper(strip(word)).isin(*ROMAN), F.lit(False))


def _without_boxes(address: Column) -> Column:
    return sub(F.coalesce(address, lit("")), POST_BOX)


#: Whether there is any abbreviated street kind: a look for first letters, which costs less than a word's boundary at each character, in place of five searches.
_ANY_KIND = "(?=[AEPRaepr])(?iU:" + "|".join(pattern for pattern, _ in STREET_KINDS) + ")"


def _spelled_out(address: Column) -> Column:
    for pattern, kind in STREET_KINDS:
        address = sub(address, "(?iU)" + pattern, kind)
    return address


def dedupe_address(address: Column) -> Column:
    """The address without post boxes and repeated parts, street kinds spelled out."""
    return _without_repeats(_spelled_out(_without_boxes(address)))


def _without_repeats(out: Column) -> Column:
    parts = F.filter(F.transform(F.split(out, ","), strip), lambda p: p != "")

    def first_of_each(own):
        lower = F.transform(own, F.lower)
        return let(lower, lambda low: F.filter(own, lambda p, i: F.array_position(low, F.get(low, i)) == i + 1))

    return strip(sub(F.array_join(let(parts, first_of_each), ", "), r"(?U)\s+", " "))


_NEVER = "(?U)^(?:" + "|".join(
    [*(f"{re.escape(x)}$" for x in ("", *BLANKS, *NEIGHBOURHOODS)), r"\d+$", r"(?:sl|sala|setor|qda|quadra|lote|bloco|apto)\s*[-:]?\s*\d*", "(?:" + "|".join(map(re.escape, NOT_MUNICIPALITY_STARTS)) + r")(?:$| |\.)"]
) + ")"


def is_municipality(name: Column) -> Column:
    """Whether the text can name a municipality."""
    return ~F.rlike(sub(F.lower(strip(F.coalesce(name, lit("")))), r"(?U)\s+", " "), F.lit(_NEVER))


def normalize_municipality(name: Column) -> Column:
    """The municipality's letters under spelling variants: z s, j g, y i, ss s, eo eu, aes ais; without prepositions, states and numbers."""
    out = F.translate(fold(name), "zjy", "sgi")
    out = sub(sub(sub(out, "ss", "s"), "eo$", "eu"), "aes$", "ais")
    kept = F.filter(words(out), lambda w: ~w.isin(*MUNICIPALITY_STOPS) & ~w.rlike("^[0-9]+$"))
    return sub(F.array_join(kept, ""), "[^a-z]")


_LAST_UF = r"(?iU)(?<=\S)\s+(" + "|".join(UFS) + r")$"


def _drop_uf(t: Column) -> Column:
    """The text without a state as its last word, its white space made single if there is one."""
    return F.when(t.rlike(_LAST_UF), strip(sub(sub(t, _LAST_UF), r"(?U)\s+", " "))).otherwise(t)


def _last_uf(t: Column) -> Column:
    return filled(F.upper(F.regexp_extract(t, _LAST_UF, 1)))


def split_municipality(text: Column) -> Column:
    """struct(muni, uf, cep) of a municipality that may carry a state, a postal code or separators."""
    def of(t):
        cep = _cep_of(t).alias("cep")
        base = rstrip_separators(_without_cep(t))
        return let(base, lambda b: F.struct(strip(sub(rstrip_separators(_drop_uf(b)), r"(?U)^\d+\s*,\s*")).alias("muni"), _last_uf(b).alias("uf"), cep))

    return let(_cep_text(rstrip_separators(strip(F.coalesce(text.cast("string"), lit(""))))), of)


def clean_municipality(text: Column) -> Column:
    return split_municipality(text)["muni"]


def protect_municipality(native: Column, candidate: Column) -> Column:
    """The native name where the candidate is the same or only its beginning, else the candidate."""
    a, b = F.btrim(fold(native)), F.btrim(fold(candidate))
    keeps = (a == b) | ((F.length(a) > F.length(b)) & a.startswith(b))
    return F.when(native == candidate, native).when(filled(native).isNull(), candidate).when(filled(candidate).isNull(), native).when(keeps, native).otherwise(candidate)


@built_once
def _parsing() -> tuple[list[dict[str, Column]], Column]:
    """The steps of parsing, which add columns ``__a_...`` to ``__a_address``, ``__a_muni`` and ``__a_uf``, and the struct that they end in."""
    none, c = F.lit(None).cast("string"), F.col
    own = lambda x: f"__a_{x}"
    m, u, raw, town, cep, t, parts, state, chosen, last, mine = (c(own(x)) for x in ("m", "u", "raw", "town", "cep", "t", "parts", "state", "chosen", "last", "own"))
    steps = [
        {own("m"): F.when(filled(c(own("muni"))).isNotNull(), clean_municipality(c(own("muni")))), own("state"): strip(F.coalesce(c(own("uf")), lit(""))), own("raw"): strip(F.coalesce(c(own("address")), lit("")))},
        {own("u"): F.when(F.length(state) >= 2, F.upper(F.substring(state, 1, 2))), own("town"): F.when(is_municipality(m), filled(m)), own("blank"): (raw == "") | (F.lower(raw) == "não informado"), own("t"): _without_boxes(strip_marks(raw))},
        {own("t"): F.when(t.rlike(_ANY_KIND), _spelled_out(t)).otherwise(t)},
        {own("t"): _cep_text(_without_repeats(t))},
        {own("cep"): _cep_of(t), own("t"): _without_cep(t)},
    ]
    # the state at the end: by pattern, by the last word, and once more as the last word, whoever gave it
    found = F.when(u.isNull(), F.upper(F.regexp_extract(t, UF_AT_END, 1)))
    has = found.isin(*UFS)
    steps.append({own("u"): F.coalesce(u, F.when(has, found)), own("t"): F.when(has, strip_marks(strip(sub(t, UF_AT_END)))).otherwise(t)})
    has = u.isNull() & t.rlike(_LAST_UF)
    steps.append({own("u"): F.coalesce(u, F.when(has, _last_uf(t))), own("t"): F.when(has, strip_marks(_drop_uf(t))).otherwise(t)})
    steps.append({own("t"): F.when(t.rlike(_LAST_UF), strip_marks(_drop_uf(t))).otherwise(t)})
    # the last part that can name a municipality; those before it aren't looked at
    named = lambda p: let(clean_municipality(p), lambda m: F.when(is_municipality(m), m))
    steps += [
        {own("parts"): F.filter(F.transform(F.split(t, ","), strip), lambda p: p != "")},
        {own("chosen"): F.aggregate(F.reverse(parts), none, lambda found, p: F.coalesce(found, named(p))), own("given"): town},
        {own("town"): F.when(chosen.isNotNull(), protect_municipality(town, chosen)).otherwise(town)},
        {own("last"): fold(F.try_element_at(parts, F.lit(-1))), own("own"): fold(town)},
    ]
    same = F.when(last == mine, True).otherwise(clean_municipality(mine).startswith(clean_municipality(last)))  # most are equal before they are cleaned
    drop = (F.size(parts) > 0) & filled(town).isNotNull() & same
    steps.append({own("parts"): F.when(drop, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)})
    n = F.size(parts)
    values = {
        "logradouro": F.get(parts, F.lit(0)),
        "numero": F.get(parts, F.lit(1)),
        "complemento": F.when(n >= 4, F.array_join(F.slice(parts, 3, F.greatest(n - 3, F.lit(0))), ", ")),
        "bairro": F.when(n == 3, F.get(parts, F.lit(2))).when(n >= 4, F.try_element_at(parts, F.lit(-1))),
        "municipio": town,
        "uf": u,
        "cep": cep,
    }
    given = {"municipio": c(own("given")), "uf": F.when(F.length(state) >= 2, F.upper(F.substring(state, 1, 2)))}
    return steps, F.struct(*[F.when(c(own("blank")), given.get(k, none)).otherwise(v).cast("string").alias(k) for k, v in values.items()])


def with_parsed_address(df: DataFrame, name: str, address: Column, muni: Column | None = None, uf: Column | None = None) -> DataFrame:
    """df with a struct column of PARTS (null if absent) of a free-text address, given what is known of its municipality and state.

    Each step is a projection of its own, so no expression is evaluated twice.  A filter on the parts would be pushed down
    through the steps and expand them: cut the lineage first (``operators.components.cut``).
    """
    none = F.lit(None).cast("string")
    steps, out = _parsing()
    before = df.columns
    df = df.withColumns({"__a_address": address, "__a_muni": none if muni is None else muni, "__a_uf": none if uf is None else uf})
    for step in steps:
        df = df.withColumns(step)
    return df.select(*[F.col(f"`{x}`") for x in before if x != name], out.alias(name))


@built_once
def _locating() -> tuple[dict[str, Column], Column]:
    c = F.col
    code, number, street = c("__l_cep"), c("__l_num"), c("__l_street")
    first = {"__l_cep": F.coalesce("__l_p.cep", lit("")), "__l_num": strip(F.coalesce("__l_p.numero", lit(""))), "__l_street": fold(F.coalesce("__l_p.logradouro", lit("")))}
    digits = sub(number, r"(?U)\D")
    values = {
        "cep": F.when(code.endswith("000") | (F.length(code) != 8), "").otherwise(code),
        "num": F.when(digits != "", digits).when(F.lower(number).isin(*NO_NUMBER), "sn").otherwise(""),
        "street": F.when(street.rlike(_STREET_KIND), strip(sub(street, _STREET_KIND))).otherwise(street),
    }
    return first, F.struct(*[F.when(c("__l_blank"), "").otherwise(v).alias(k) for k, v in values.items()])


def with_known_address(df: DataFrame, name: str, address: Column, muni: Column, uf: Column, known: Column, same: Column) -> DataFrame:
    """``with_parsed_address`` that takes ``known`` where ``same`` tells that it was parsed from the same values; only other rows are parsed."""
    again = F.col("__k_again")
    df = df.withColumns({"__k_again": ~F.coalesce(same, F.lit(False)), "__k_known": known})
    df = with_parsed_address(df, name, *[F.when(again, x) for x in (address, muni, uf)])
    return df.withColumn(name, F.when(again, F.col(name)).otherwise(F.col("__k_known"))).drop("__k_again", "__k_known")


def with_location(df: DataFrame, name: str, address: Column, muni: Column, uf: Column, known: Column | None = None, same: Column | None = None, parsed: str | None = None) -> DataFrame:
    """df with struct(cep, num, street) for matching: a street-level postal code, the number's digits or ``sn``, the folded street without its kind.

    known, same: a parsed address and whether it is that of the same values.  parsed: a name to keep the parsed address by.
    """
    first, out = _locating()
    before = df.columns
    raw = F.lower(strip(F.coalesce(address, lit(""))))
    df = df.withColumn("__l_blank", raw.isin("", *BLANKS))
    df = with_parsed_address(df, "__l_p", address, muni, uf) if known is None else with_known_address(df, "__l_p", address, muni, uf, known, same)
    kept = [F.col("__l_p").alias(parsed)] if parsed else []
    return df.withColumns(first).select(*[F.col(f"`{x}`") for x in before if x not in (name, parsed)], *kept, out.alias(name))


# folding has removed the accents, so the accented kinds can't occur
_STREET_KIND = "^(?:" + "|".join(x for x in STREET_STARTS if x.isascii()) + ")"
