"""Names of institutions: folding, abbreviations, keys and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import built_once, fold, let, lit, strip, sub, words

# Abbreviations and what they stand for, in the order in which they are expanded.
ABBREVIATIONS = (
    (r"\b(ee|e\s*e)\b", "escola estadual"),
    (r"\b(em|e\s*m)\b", "escola municipal"),
    (r"\b(ce|c\s*e)\b", "colegio estadual"),
    (r"\b(ceja|c\s*e\s*j\s*a)\b", "centro de educacao de jovens e adultos"),
    (r"\b(esc\s*tec\s*est)\b", "escola tecnica estadual"),
    (r"\b(esc\s*tec)\b", "escola tecnica"),
    (r"\besc\b", "escola"),
    (r"\btec\b", "tecnica"),
    (r"\best\b", "estadual"),
    (r"\bprof\b|\bprofa\b", "professor"),
    (r"\bdr\b|\bdra\b", "doutor"),
    (r"\bpres\b", "presidente"),
    (r"\bsta\b", "santa"),
    (r"\bsto\b", "santo"),
    (r"\bnsra\b|\bns\b", "nossa senhora"),
    (r"\beem\b", "escola de ensino medio"),
    (r"\beeb\b", "escola de educacao basica"),
    (r"\beepp?\b", "escola de educacao profissional"),
    (r"\bceep\b", "centro estadual de educacao profissional"),
    (r"\bciep\b", "centro integrado de educacao publica"),
    (r"\bunicasul\b|\bunicsul\b", "universidade cruzeiro do sul"),
    (r"\bassis\b", "francisco de assis"),
    (r"\bkubistchek\b", "kubitschek"),
)

# Phrases that a core name is without, in the order in which they are removed.
GENERIC_PHRASES = (
    "escola tecnica estadual de educacao profissional", "escola tecnica estadual", "escola tecnica municipal", "escola tecnica de educacao profissional", "escola tecnica",
    "escola estadual de educacao profissional", "escola estadual de educacao basica", "escola estadual de ensino medio", "escola estadual", "escola municipal",
    "instituto federal", "universidade", "faculdade", "colegio estadual", "colegio", "centro de educacao de jovens e adultos", "centro estadual de educacao profissional",
    "centro de educacao profissional", "centro educacional", "centro integrado de educacao publica", "centro de excelencia", "escola de educacao profissional",
    "escola de especializacao", "escola agropecuaria", "escola de musica", "liceu pedagogico", "escola senai", "hotel escola senac", "hotel escola",
    "instituto de ensino e cultura", "instituto educacional de contagem", "centro de profissionalizacao do vale do", "centro de profissionalizacao", "centro tecnico potiguar",
)

# Course-level suffixes, places, name words without weight, acronyms.
SUFFIXES = r"\b(c\s*e[\s\-]*ef\s*m\s*eti\s*prof|c\s*e[\s\-]*ef\s*m\s*profis|c\s*e\s*c\s*m\s*efmp|c\s*e\s*e\s*fund\s*med|e\s*e\s*e\s*fund|ef\s*m\s*eti\s*prof|ef\s*m\s*profis|fund\s*med|ens\s*med|ens\s*fund|eti\s*prof|profis|efmp|eti|ef\s*m|ef|em|mp)\b"
PLACES = r"\b(de poxoreu|de poxoreo|de contagem|do sul|de jacarei|de manaus|assu|acu)\b"
TOKEN_STOPS = ("escola", "estadual", "municipal", "tecnica", "profissional", "educacao", "centro", "instituto")
RICHNESS_ACRONYMS = ("ce", "ee", "em", "efmp", "eti", "profis", "ef", "mp", "ead", "p", "c", "m")
PEDAGOGICAL = (r"\befmp\b", r"\beti\b", r"\bprofis\b", r"\bens\s+fund\b", r"\bmedio\b", r"\be\s+e\s+e\s+fund\b", r"\bc\s*e\b", r"\be\s*e\b", r"\be\s*e\s*b\b", r"\bcm\b", r"\bemp\b", r"\bmp\b")
DISTANCE = r"\b(ead|ea d|poloead|distancia)\b|\(ead\)"
MISSING = "não informado"


def squeeze(text: Column) -> Column:
    return F.btrim(sub(text, r"\s+", " "))


#: What a text must hold for each abbreviation to be in it.
_HINTS = ("e", "m", "c", "j", "esc", "esc", "esc", "tec", "est", "prof", "dr", "pres", "sta", "sto", "ns", "eem", "eeb", "eep", "ceep", "ciep", "unic", "assis", "kubistchek")


_BOUNDARY = r"\b"


def _ahead(pattern: str) -> str:
    """The pattern behind a look at its first letter, which all its branches share and which costs less than a word's boundary at each character."""
    return f"(?={pattern.replace(_BOUNDARY, '').lstrip('(')[0]})(?:{pattern})"


@built_once
def _abbreviations() -> Column:
    return _rules((hint, _ahead(pattern), new) for hint, (pattern, new) in zip(_HINTS, ABBREVIATIONS, strict=True))


@built_once
def _phrases() -> Column:
    return _rules((p, rf"\b{p}\b", " ") for p in GENERIC_PHRASES)


def _rules(rows) -> Column:
    """A literal list of (hint, pattern, new)."""
    text = lambda x: "'" + x.replace("\\", "\\\\") + "'"
    return F.expr("array(" + ", ".join(f"struct({text(h)} as hint, {text(p)} as pattern, {text(n)} as new)" for h, p, n in rows) + ")")


def _replaced(text: Column, rules: Column) -> Column:
    """The text after one rule after the other; a rule whose hint isn't in it costs a search for the hint only.

    A fold over a list in place of a nest of as many patterns, whose generated code is too long to be compiled well.
    """
    return F.aggregate(rules, text, lambda t, r: F.when(F.contains(t, r["hint"]), F.regexp_replace(t, r["pattern"], r["new"])).otherwise(t))


def expand(name: Column) -> Column:
    """The folded name with its abbreviations spelled out."""
    return squeeze(_replaced(fold(name), _abbreviations()))


def distance_learning(name: Column) -> Column:
    """Whether the name says that the institution teaches at a distance."""
    raw = F.lower(F.coalesce(name, lit("")))
    return raw.rlike("(?U)" + DISTANCE) | F.contains(fold(raw), F.lit("a distancia"))


def richness(name: Column) -> Column:
    """How telling a name is: 3 for a word of 5 letters or more, 1 for one of 3 or 4, 2 less for an acronym; 0 at least."""
    long_enough = F.filter(words(fold(name)), lambda w: F.length(w) >= 3)
    score = F.transform(long_enough, lambda w: F.when(w.isin(*RICHNESS_ACRONYMS), -2).when(F.length(w) >= 5, 3).otherwise(1))
    return F.greatest(F.aggregate(score, F.lit(0), lambda a, x: a + x), F.lit(0))


def core_name(name: Column, expanded: Column | None = None) -> Column:
    """The name without generic phrases, suffixes and places, letters and digits only."""
    out = _replaced(expand(name) if expanded is None else expanded, _phrases())
    return sub(sub(sub(out, SUFFIXES, " "), PLACES, " "), "[^a-z0-9]")


def name_tokens(expanded: Column) -> Column:
    """The expanded name's telling words, sorted and joined by underscores."""
    return F.array_join(F.array_sort(F.filter(words(expanded), lambda w: (F.length(w) >= 3) & ~w.isin(*TOKEN_STOPS))), "_")


def natural_key(name: Column, muni_norm: Column, uf: Column, uf_in_key: bool = False, expanded: Column | None = None) -> Column:
    """name_municipality_uf with a mark for distance learning, in a-z, 0-9 and _.

    By default the state leaves only its underscore, as upper-case letters are removed; ``uf_in_key`` keeps it.
    """
    state = F.substring(F.upper(fold(uf)), 1, 2)
    state = F.lower(state) if uf_in_key else state
    held = F.filter(F.array(expand(name) if expanded is None else expanded, muni_norm, state), lambda p: p != "")
    return sub(F.concat(strip(F.array_join(held, "_")), F.when(distance_learning(name), "_ead").otherwise("")), "[^a-z0-9_]")


def clean_pedagogical(name: Column) -> Column:
    """The folded name without course-level acronyms; Roman numerals stay."""
    out = sub(F.lower(F.coalesce(name, lit(""))), r"[\-/,]", " ")
    out = reduce(lambda t, p: sub(t, "(?U)" + p, " "), PEDAGOGICAL, out)
    return fold(strip(sub(out, r"(?U)\s+", " ")))


def sentinel(text: Column) -> Column:
    """The stripped text, or the mark for a missing one."""
    return let(strip(F.coalesce(text.cast("string"), lit(""))), lambda t: F.when(F.coalesce(text.cast("string"), lit("")) == "", F.lit(MISSING)).otherwise(t))
