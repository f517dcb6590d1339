"""The functions for SQL text: temporary SQL functions, which Spark inlines, so queries that call them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import SparkSession

from . import address, base, text


def _text(value: str) -> str:
    """A SQL literal that reads the same whatever the parser's escapes."""
    return "'" + "".join(c if " " <= c <= "~" and c not in "'\\" else f"\\u{ord(c):04x}" for c in value) + "'"


def _list(values) -> str:
    return ", ".join(map(_text, values))


def _sub(x: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({x}, {_text(pattern)}, {_text(new)})"


def _like(x: str, pattern: str) -> str:
    return f"({x} RLIKE {_text(pattern)})"


def _strip(x: str, ends: str = base._BLANK) -> str:
    return f"btrim({x}, {_text(ends)})"


def _no_separators(x: str) -> str:
    return f"ltrim({_text(base._BLANK)} FROM rtrim({_text(base._SEPARATORS)} FROM {x}))".replace("ltrim(", "trim(LEADING ", 1).replace("rtrim(", "trim(TRAILING ", 1)


def _words(x: str) -> str:
    return f"filter(split({x}, {_text(r'(?U)\s+')}), w -> w <> '')"


def _replaced(x: str, rules) -> str:
    rows = ", ".join(f"struct({_text(h)} AS hint, {_text(p)} AS pattern, {_text(n)} AS new)" for h, p, n in rules)
    return f"aggregate(array({rows}), {x}, (t, r) -> CASE WHEN contains(t, r.hint) THEN regexp_replace(t, r.pattern, r.new) ELSE t END)"


_FOLDED = _sub(_sub(f"translate({_strip("lower(coalesce(x, ''))")}, {_text(base._OLD)}, {_text(base._NEW)})", r"\p{M}"), r"(?U)[^a-z0-9\s]", " ")
_ABBREVIATIONS = [(h, *r) for h, r in zip(text._HINTS, text.ABBREVIATIONS, strict=True)]
_PHRASES = [(p, rf"\b{p}\b", " ") for p in text.GENERIC_PHRASES]
_SCORE = f"CASE WHEN w IN ({_list(text.RICHNESS_ACRONYMS)}) THEN -2 WHEN length(w) >= 5 THEN 3 ELSE 1 END"
_SPELLING = reduce(lambda t, r: _sub(t, *r), (("ss", "s"), ("eo$", "eu"), ("aes$", "ais")), "translate(rs_fold(x), 'zjy', 'sgi')")
_KEPT = f"filter({_words(_SPELLING)}, w -> w NOT IN ({_list(address.MUNICIPALITY_STOPS)}) AND NOT w RLIKE '^[0-9]+$')"
_CODE_TEXT = _no_separators(_strip(_strip("coalesce(x, '')"), ".,;- "))
_NO_CODE = _no_separators(_strip(_strip(_sub(_strip(_sub("x", address.CEP_AT_END)), address.CEP_ANYWHERE)), ".,;- "))
_NO_STATE = f"CASE WHEN {_like('x', address._LAST_UF)} THEN {_strip(_sub(_sub('x', address._LAST_UF), r'(?U)\s+', ' '))} ELSE x END"
_KINDS = reduce(lambda t, r: _sub(t, "(?iU)" + r[0], r[1]), address.STREET_KINDS, _sub("coalesce(x, '')", address.POST_BOX))
_ADDRESS_PARTS = f"filter(transform(split({_KINDS}, ','), p -> {_strip('p')}), p -> p <> '')"

#: Name, arguments, result and body; later bodies call earlier functions.  Those that end in an underscore are parts of others.
SCALARS = (
    ("rs_fold", "x STRING", "STRING", _FOLDED),
    ("rs_expand", "x STRING", "STRING", f"btrim({_sub(_replaced('rs_fold(x)', _ABBREVIATIONS), r'\s+', ' ')})"),
    ("rs_core_name", "x STRING", "STRING", _sub(_sub(_sub(_replaced("rs_expand(x)", _PHRASES), text.SUFFIXES, " "), text.PLACES, " "), "[^a-z0-9]")),
    ("rs_richness", "x STRING", "INT", f"greatest(aggregate(transform(filter({_words('rs_fold(x)')}, w -> length(w) >= 3), w -> {_SCORE}), 0, (a, v) -> a + v), 0)"),
    ("rs_distance_learning", "x STRING", "BOOLEAN", f"{_like("lower(coalesce(x, ''))", '(?U)' + text.DISTANCE)} OR contains(rs_fold(x), 'a distancia')"),
    ("rs_name_tokens", "x STRING", "STRING", f"array_join(array_sort(filter({_words('rs_expand(x)')}, w -> length(w) >= 3 AND w NOT IN ({_list(text.TOKEN_STOPS)}))), '_')"),
    ("rs_muni_norm", "x STRING", "STRING", _sub(f"array_join({_KEPT}, '')", "[^a-z]")),
    ("rs_code_text_", "x STRING", "STRING", _CODE_TEXT),
    ("rs_code_of_", "x STRING", "STRING", f"nullif({_sub(f'regexp_extract(x, {_text(address.CEP_AT_END)}, 1)', r'\D')}, '')"),
    ("rs_no_code_", "x STRING", "STRING", _NO_CODE),
    ("rs_no_state_", "x STRING", "STRING", _NO_STATE),
    ("rs_muni_base_", "x STRING", "STRING", f"rs_no_code_(rs_code_text_({_no_separators(_strip("coalesce(x, '')"))}))"),
    ("rs_muni_clean", "x STRING", "STRING", _strip(_sub(_no_separators("rs_no_state_(rs_muni_base_(x))"), r"(?U)^\d+\s*,\s*"))),
    ("rs_muni_uf", "x STRING", "STRING", f"nullif(upper(regexp_extract(rs_muni_base_(x), {_text(address._LAST_UF)}, 1)), '')"),
    ("rs_muni_cep", "x STRING", "STRING", f"rs_code_of_(rs_code_text_({_no_separators(_strip("coalesce(x, '')"))}))"),
    ("rs_is_municipality", "x STRING", "BOOLEAN", f"NOT {_like(_sub(f"lower({_strip("coalesce(x, '')")})", r'(?U)\s+', ' '), address._NEVER)}"),
    ("rs_cep", "x STRING", "STRING", "rs_code_of_(rs_code_text_(x))"),
    ("rs_without_cep", "x STRING", "STRING", "rs_no_code_(rs_code_text_(x))"),
    ("rs_digits_", "x STRING", "STRING", _sub("coalesce(x, '')", r"\D")),
    ("rs_format_cep", "x STRING", "STRING", "CASE WHEN length(rs_digits_(x)) = 8 THEN concat(substring(rs_digits_(x), 1, 5), '-', substring(rs_digits_(x), 6, 3)) ELSE rs_digits_(x) END"),
    ("rs_is_cep", "x STRING", "BOOLEAN", "length(rs_digits_(x)) BETWEEN 5 AND 8"),
    ("rs_first_parts_", "p ARRAY<STRING>", "ARRAY<STRING>", "filter(p, (v, i) -> array_position(transform(p, z -> lower(z)), lower(v)) = i + 1)"),
    ("rs_dedupe_address", "x STRING", "STRING", _strip(_sub(f"array_join(rs_first_parts_({_ADDRESS_PARTS}), ', ')", r"(?U)\s+", " "))),
    ("rs_is_roman", "x STRING", "BOOLEAN", f"coalesce(upper({_strip('x')}) IN ({_list(address.ROMAN)}), false)"),
    ("rs_protect_muni", "native STRING, candidate STRING", "STRING", "CASE WHEN nullif(native, '') IS NULL THEN candidate WHEN nullif(candidate, '') IS NULL THEN native WHEN btrim(rs_fold(native)) = btrim(rs_fold(candidate)) OR (length(btrim(rs_fold(native))) > length(btrim(rs_fold(candidate))) AND startswith(btrim(rs_fold(native)), btrim(rs_fold(candidate)))) THEN native ELSE candidate END"),
    ("rs_natural_key", "name STRING, muni_norm STRING, uf STRING", "STRING", _sub(f"concat({_strip("array_join(filter(array(rs_expand(name), muni_norm, substring(upper(rs_fold(uf)), 1, 2)), p -> p <> ''), '_')")}, CASE WHEN rs_distance_learning(name) THEN '_ead' ELSE '' END)", "[^a-z0-9_]")),
)

#: The same for functions that return rows.
TABLES = (
    ("rs_address_parts", "x STRING", "ord INT, parte STRING", f"SELECT pos + 1, {_strip('col')} FROM posexplode(split(coalesce(x, ''), ',')) WHERE {_strip('col')} <> ''"),
    ("rs_telling_words", "x STRING", "palavra STRING", f"SELECT DISTINCT col FROM explode({_words(_FOLDED)}) WHERE length(col) >= 4"),
)

#: The column functions of one argument behind the scalar functions.
FUNCTIONS = {
    "rs_fold": base.fold,
    "rs_expand": text.expand,
    "rs_core_name": text.core_name,
    "rs_richness": text.richness,
    "rs_distance_learning": text.distance_learning,
    "rs_name_tokens": lambda c: text.name_tokens(text.expand(c)),
    "rs_muni_norm": address.normalize_municipality,
    "rs_muni_clean": address.clean_municipality,
    "rs_muni_uf": lambda c: address.split_municipality(c)["uf"],
    "rs_muni_cep": lambda c: address.split_municipality(c)["cep"],
    "rs_is_municipality": address.is_municipality,
    "rs_cep": lambda c: address.extract_cep(c)["cep"],
    "rs_without_cep": lambda c: address.extract_cep(c)["text"],
    "rs_format_cep": address.format_cep,
    "rs_is_cep": address.is_cep,
    "rs_dedupe_address": address.dedupe_address,
    "rs_is_roman": address.is_roman,
}


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session's SQL; returns their names.  Existing ones of these names are replaced."""
    for name, arguments, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, arguments, result, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({result}) RETURN {body}")
    return [name for name, *_ in (*SCALARS, *TABLES) if not name.endswith("_")]
