"""Reports of a comparison: four tables as CSV, a workbook, and a text diagnosis."""

from __future__ import annotations

import re
import zipfile
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import PARTS, with_parsed_address
from ..functions.base import first_filled

#: Names of the workbook's sheets, and the rows that a sheet holds at most.
SHEETS, SHEET_ROWS = ("Novos", "Alterados", "Inativados", "Ofertas de Cursos"), 1_048_576
_PARTS = ("logradouro", "numero", "complemento", "bairro", "municipio", "uf", "cep")


def _parsed(rows: DataFrame) -> DataFrame:
    df = with_parsed_address(rows, "p", F.col("endereco"))
    have = set(rows.columns)
    return df.withColumns({f"r_{x}": first_filled(*([F.col(x)] if x in have else []), F.col(f"p.{x}")) for x in PARTS})


def new_report(rows: DataFrame) -> DataFrame:
    """New institutions; NOVO stands for an id that isn't given yet."""
    df = _parsed(rows.where("status = 'novo'"))
    return df.select(F.coalesce(F.col("id").cast("string"), F.lit("NOVO")).alias("snowflake_id"), F.col("nome").alias("nome_instituicao"), "dependencia_adm", "endereco", *[F.col(f"r_{x}").alias(x) for x in _PARTS], "telefone", "email", "homepage")


def changed_report(rows: DataFrame) -> DataFrame:
    """Changed institutions with their differences."""
    df = _parsed(rows.where("status = 'alterado'"))
    return df.select(F.col("id").alias("snowflake_id"), F.col("nome").alias("nome_instituicao"), "dependencia_adm", F.coalesce("endereco_db", F.lit("")).alias("endereco_anterior"), F.col("endereco").alias("endereco_novo"), *[F.col(f"r_{x}").alias(x) for x in _PARTS], F.array_join("diferencas", " | ").alias("diferencas_detectadas"))


def inactive_report(rows: DataFrame) -> DataFrame:
    """Inactivated institutions."""
    df = _parsed(rows.where("status = 'inativado'"))
    return df.select(F.col("id").alias("snowflake_id"), F.col("nome").alias("nome_instituicao"), "dependencia_adm", "endereco", *[F.col(f"r_{x}").alias(x) for x in _PARTS], F.lit("Inativado (ativo=0)").alias("status_migracao"))


def course_report(details: DataFrame) -> DataFrame:
    return details.select(F.col("id").alias("snowflake_id"), "nome_instituicao", F.col("tipo").alias("tipo_alteracao"), F.col("curso").alias("nome_curso"))


def ascii_table(df: DataFrame, columns: list[tuple[str, int | None]], order: list, most: int = 50, none: str = "Nenhum registro.", more: str = "... e mais {}") -> DataFrame:
    """(n, linha): the first ``most`` rows as lines of fixed-width columns (None: as long as the text), with how many more there are on the last; ``none`` if there are no rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cell = lambda c, w: text(c) if w is None else F.rpad(F.substring(text(c), 1, w), w, " ")
    line: Column = F.concat_ws(" | ", *[cell(c, w) for c, w in columns])
    from pyspark.sql import Window

    shown = df.orderBy(*order).limit(most)
    lines = shown.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("n"), line.alias("linha"))  # at most ``most`` rows
    total = df.agg(F.count("*").alias("t"))
    before, after = more.split("{}")
    rest = total.select(F.lit(most + 1).cast("long").alias("n"), F.concat(F.lit(before), (F.col("t") - most).cast("string"), F.lit(after)).alias("linha"), "t").where(F.col("t") > most).drop("t")
    empty = total.where("t = 0").select(F.lit(1).cast("long").alias("n"), F.lit(none).alias("linha"))
    return lines.unionByName(rest).unionByName(empty)


# The sections of the text diagnosis: title, line without rows, line for further rows, and for each column its head, name and width.
SECTIONS = (
    ("1. RELAÇÃO DE INSTITUIÇÕES NOVAS IDENTIFICADAS", "Nenhuma nova instituição identificada no lote importado.", "... e mais {} instituições novas no lote.",
     (("SNOWFLAKE ID", "snowflake_id", 15), ("NOME DA INSTITUIÇÃO", "nome_instituicao", 45), ("DEP. ADM", "dependencia_adm", 15), ("ENDEREÇO COMPLETO", "endereco", None)), 149),
    ("2. COMPARAÇÃO DE ALTERAÇÕES CADASTRAIS (BANCO MYSQL vs RASPAGEM CNCT)", "Nenhuma alteração cadastral identificada no lote importado.", "... e mais {} alterações cadastrais no lote.",
     (("SNOWFLAKE ID", "snowflake_id", 18), ("NOME DA INSTITUIÇÃO", "nome_instituicao", 40), ("DIVERGÊNCIAS DETECTADAS", "diferencas_detectadas", None)), 124),
    ("3. RELAÇÃO DE INSTITUIÇÕES A SEREM INATIVADAS (ativo = 0)", "Nenhuma instituição a ser inativada.", "... e mais {} instituições a serem inativadas no lote.",
     (("SNOWFLAKE ID", "snowflake_id", 18), ("NOME DA INSTITUIÇÃO", "nome_instituicao", 40), ("ENDEREÇO BANCO", "endereco", None)), 124),
    ("4. DETALHAMENTO DE CURSOS E OFERTAS (NOVOS VÍNCULOS / ENCERRADOS)", "Nenhuma alteração em ofertas de cursos identificada.", "... e mais {} detalhamentos de cursos no lote.",
     (("SNOWFLAKE ID", "snowflake_id", 18), ("NOME DA INSTITUIÇÃO", "nome_instituicao", 35), ("TIPO", "tipo_alteracao", 15), ("NOME DO CURSO", "nome_curso", None)), 122),
)
# The diagnosis' other lines, with the summary's columns in braces.
HEADING = "DIAGNÓSTICO E RELATÓRIO COMPLETO DE MIGRAÇÃO CNCT (C ENGINE)"
MODES = ("COMPLETA (Carga Nacional)", "PARCIAL (Carga por Estado/Filtro)")
TOTALS = (
    "Total de Instituições no Banco de Dados (VPS): {total_db}",
    "Total de Instituições no Lote Importado (CSV): {total_csv}",
    "Total de Cursos Únicos Identificados no CSV: {cursos_unicos_csv_qtd}",
    "Modo de Importação: {modo}",
)
CHANGES = (
    "RESUMO EXECUTIVO DE MUDANÇAS DE ESTADO:",
    "  1. RELAÇÃO DE INSTITUIÇÕES NOVAS IDENTIFICADAS (INSERT): {novos_qtd}",
    "  2. COMPARAÇÃO DE ALTERAÇÕES CADASTRAIS (UPDATE): {alterados_qtd}",
    "  3. INSTITUIÇÕES MANTIDAS SEM ALTERAÇÕES (MANTIDOS): {mantidos_qtd}",
    "  4. INSTITUIÇÕES REATIVADAS (SET ATIVO=1): {reativados_qtd}",
    "  5. RELAÇÃO DE INSTITUIÇÕES A SEREM INATIVADAS (SET ATIVO=0): {inativados_qtd} {ignorado}",
)
OFFERS = (
    "MUDANÇAS DE OFERTAS DE CURSOS (NÍVEL DE CURSOS):",
    "  - Novas Ofertas Vinculadas: {novos_cursos_qtd}",
    "  - Ofertas Mantidas: {cursos_mantidos_qtd}",
    "  - Ofertas Descontinuadas/Encerradas: {cursos_descontinuados_qtd}",
)
IGNORED = "(Ignorado em Carga Parcial)"
WIDTH = 90


def section(number: int, df: DataFrame, order: list) -> DataFrame:
    """(n, linha): a section's head, rule and rows (at most 50 and how many more there are)."""
    _, none, more, columns, rule = SECTIONS[number]
    rows = ascii_table(df, [(c, w) for _, c, w in columns], order, none=none, more=more)
    head = " | ".join(h if w is None else h.ljust(w) for h, _, w in columns)
    top = df.limit(1).select(F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(x).alias("linha")) for n, x in ((-1, head), (0, "-" * rule))])).alias("x")).select("x.*")
    return top.unionByName(rows)


def diagnosis(summary: DataFrame, rows: DataFrame, details: DataFrame) -> str:
    """The text report: totals, mode, counts, course statistics and the four sections."""
    s = summary.first().asDict()
    s |= {"modo": MODES[bool(s["is_parcial"])], "ignorado": IGNORED if s["is_parcial"] else ""}
    heavy, light = "=" * WIDTH, "-" * WIDTH
    out = [heavy, HEADING, heavy, *TOTALS, light, *CHANGES, light, *OFFERS, light]
    out = [line.format(**s) for line in out]
    for i, df in enumerate(reports(rows, details).values()):
        body = [r.linha for r in section(i, df, ["snowflake_id", "nome_instituicao"]).orderBy("n").collect()]
        out += ["" if i == 0 else "\n", SECTIONS[i][0], heavy, *body]
    return "\n".join(out)


def column_letters(index: int) -> str:
    """1: A, 26: Z, 27: AA."""
    out = ""
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"


def write_xlsx(path: str, sheets: dict[str, DataFrame]) -> None:
    """A workbook with a sheet for each table, streamed row by row; texts are inline, the header row is bold."""
    titles = [_CONTROL.sub("", t)[:31] for t in sheets]

    def cell(row: int, col: int, value, style: int) -> str:
        text = "" if value is None else str(value)
        return f'<c r="{column_letters(col)}{row}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(_CONTROL.sub("", text))}</t></is></c>'

    def line(row: int, values, style: int = 0) -> bytes:
        return f'<row r="{row}">{"".join(cell(row, i, v, style) for i, v in enumerate(values, 1))}</row>'.encode()

    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(titles) + 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{"".join(f"""<sheet name="{escape(t)}" sheetId="{i}" r:id="rId{i}"/>""" for i, t in enumerate(titles, 1))}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACK}/relationships">{"".join(f"""<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>""" for i in range(1, len(titles) + 1))}<Relationship Id="rId{len(titles) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, _HEAD + text)
        for i, df in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode() + line(1, df.columns, 1))
                for row, values in enumerate(df.toLocalIterator(), 2):
                    if row > SHEET_ROWS:
                        raise ValueError(f"{titles[i - 1]} has more rows than a sheet can hold")
                    f.write(line(row, values))
                f.write(b"</sheetData></worksheet>")


def read_xlsx(path: str) -> dict[str, list[list[str]]]:
    """The cells of a workbook that ``write_xlsx`` wrote."""
    from xml.etree import ElementTree as E

    out = {}
    with zipfile.ZipFile(path) as z:
        names = [s.get("name") for s in E.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")]
        for i, name in enumerate(names, 1):
            rows = E.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{{{_MAIN}}}row")
            out[name] = [["".join(c.itertext()) for c in r] for r in rows]
    return out


def report_paths(folder: str) -> dict[str, str]:
    names = ("diff_1_novos", "diff_2_alterados", "diff_3_inativados", "diff_4_ofertas")
    return {n: f"{folder}/{n}" for n in names} | {"diff_relatorio_completo": f"{folder}/diff_relatorio_completo.xlsx"}


def reports(rows: DataFrame, details: DataFrame) -> dict[str, DataFrame]:
    return dict(zip(SHEETS, (new_report(rows), changed_report(rows), inactive_report(rows), course_report(details)), strict=True))


def export(rows: DataFrame, details: DataFrame, folder: str) -> dict[str, str]:
    """Writes the four CSV tables and the workbook; returns their paths."""
    from ..sources.files import write_csv

    paths, tables = report_paths(folder), reports(rows, details)
    for name, df in zip(list(paths)[:4], tables.values(), strict=True):
        write_csv(df, paths[name])
    write_xlsx(paths["diff_relatorio_completo"], tables)
    return paths
