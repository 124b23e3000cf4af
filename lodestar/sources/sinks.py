"""Outputs of a run: CSV tables, workbook, report, audit lines, checkpoint, log."""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import chain, islice
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import join_list
from lodestar.operators import coverage

#: Tables of a run by file; the columns follow the schemas.
TABLES = ("phone_inventory", "phone_occurrences", "url_inventory", "crawl_report", "crawl_errors", "pages", "sitemaps")
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def flat(df: DataFrame) -> DataFrame:
    """Lists joined by " | ", times as ISO 8601: what a CSV can hold. Integers stay integers, and nulls empty."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            c = join_list(c.cast("array<string>"))
        elif isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, ISO)
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            continue
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, single: bool = False) -> str:
    """A folder of CSV files with headers, or one file's worth if single; an empty table has its header."""
    rows = flat(df)
    rows = rows.coalesce(1) if single else rows
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def export_csvs(tables: dict[str, DataFrame], output: str) -> dict[str, str]:
    return {name: write_csv(tables[name], f"{output}/{name}.csv") for name in TABLES if name in tables}


def write_json(df: DataFrame, path: str, append: bool = False) -> str:
    """JSON lines, such as the audit of pages."""
    df.write.mode("append" if append else "overwrite").json(path)
    return path


def export_report(payload: dict, output: str) -> dict[str, str]:
    os.makedirs(output, exist_ok=True)
    paths = {"json": f"{output}/crawl_report.json", "markdown": f"{output}/crawl_report.md"}
    stamped = {"generated_at": datetime.now(UTC).isoformat()} | payload
    with open(paths["json"], "w", encoding="utf-8") as f:
        json.dump(stamped, f, indent=2, default=str)
    with open(paths["markdown"], "w", encoding="utf-8") as f:
        f.write(coverage.markdown(payload))
    return paths


# --- workbook ---

# Columns that are text even if they look like numbers, and columns of links.
TEXT_COLUMNS = ("raw_phone", "normalized_phone", "e164_phone", "national_format", "extension")
LINK_COLUMNS = ("source_url", "final_url", "referring_url", "first_seen_url", "url", "requested_url", "canonical_url", "normalized_url")
#: What a sheet holds at most.
SHEET_ROWS = 1_048_576
CELL = 32_767


def _name(column: int) -> str:
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


def _clean(value: object) -> str:
    return escape("".join(c for c in str(value)[:CELL] if c >= " " or c in "\t\n\r"))


def _sheet(header: list[str], rows: Iterator[tuple], styled: bool, extra: list[tuple[list[str], list[tuple]]]) -> tuple[str, str]:
    """XML of a sheet, and of its links."""
    lines, widths, links, n = [], [len(h) for h in header], [], 0

    def add(values: tuple | list, bold: bool = False) -> None:
        nonlocal n
        n += 1
        cells = []
        for i, v in enumerate(values):
            if v is None:
                continue
            place = f"{_name(i)}{n}"
            text_column = i < len(header) and header[i] in TEXT_COLUMNS
            style = 1 if bold else 2 if text_column else 0
            if isinstance(v, bool):
                cells.append(f'<c r="{place}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)) and not text_column:
                cells.append(f'<c r="{place}"><v>{v}</v></c>')
            else:
                cells.append(f'<c r="{place}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{_clean(v)}</t></is></c>')
                if i < len(widths):
                    widths[i] = max(widths[i], min(len(str(v)), 55))
                if not bold and i < len(header) and header[i] in LINK_COLUMNS and str(v).startswith("http") and len(links) < 65_530:
                    links.append((place, str(v)))
        lines.append(f'<row r="{n}">{"".join(cells)}</row>')

    add(header, bold=True)
    for row in islice(rows, SHEET_ROWS - 1):
        add(row)
    last = n
    for head, part in extra:
        n += 1
        add(head, bold=True)
        for row in part:
            add(row)
    cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{max(14, w + 2)}" customWidth="1"/>' for i, w in enumerate(widths))
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    table = f'<autoFilter ref="A1:{_name(len(header) - 1)}{last}"/>' if styled and header else ""
    marks = "".join(f'<hyperlink ref="{p}" r:id="rId{k}"/>' for k, (p, _) in enumerate(links, 1))
    marks = f"<hyperlinks>{marks}</hyperlinks>" if marks else ""
    xml = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{view}<cols>{cols}</cols><sheetData>{"".join(lines)}</sheetData>{table}{marks}</worksheet>'
    rels = "".join(f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink" Target="{escape(u, {chr(34): "&quot;"})}" TargetMode="External"/>' for k, (_, u) in enumerate(links, 1))
    return xml, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>' if rels else ""


def export_workbook(sheets: dict[str, DataFrame], path: str, under_summary: list[DataFrame] | None = None) -> str:
    """An XLSX file of a sheet for each table, read a partition at a time; a table that is longer than a sheet goes on in further ones."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names, kinds = [], []
        for name, df in sheets.items():
            table = flat(df)
            rows, part = (tuple(r) for r in table.toLocalIterator()), 0
            head = next(rows, None)
            while part == 0 or head is not None:
                part += 1
                k = len(kinds) + 1
                extra = [(t.columns, [tuple(r) for r in t.collect()]) for t in under_summary or []] if name == "Summary" else []
                xml, rels = _sheet(table.columns, chain([head] if head is not None else [], rows), name != "Summary", extra)
                z.writestr(f"xl/worksheets/sheet{k}.xml", xml)
                if rels:
                    z.writestr(f"xl/worksheets/_rels/sheet{k}.xml.rels", rels)
                title = name[:31] if part == 1 else f"{name[:25]} ({part})"
                names.append(f'<sheet name="{escape(title)}" sheetId="{k}" r:id="rId{k}"/>')
                kinds.append(k)
                head = next(rows, None)
        main = "http://schemas.openxmlformats.org"
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}/spreadsheetml/2006/main" xmlns:r="{main}/officeDocument/2006/relationships"><sheets>{"".join(names)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{main}/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{main}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in kinds) + f'<Relationship Id="rId{len(kinds) + 1}" Type="{main}/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="49" applyNumberFormat="1"/></cellXfs></styleSheet>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="rId1" Type="{main}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in kinds)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{main}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{parts}</Types>')
    return path


# --- checkpoint ---


class Checkpoint:
    """State of a run as tables: pending, visited and occurrences, by level. A level counts once its marker is written, so a
    level that was broken off is read as if it had never been, and writing it again replaces it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, level: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/level={level}/{name}")
        self.spark.createDataFrame([(level,)], "level int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/level={level}")

    def levels(self) -> list[int]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        done = [s.getPath() for s in fs.listStatus(where)]
        return sorted(int(p.getName().split("=")[1]) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def load(self, name: str) -> DataFrame | None:
        out, jvm = None, self.spark._jvm
        for level in self.levels():
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/level={level}/{name}")
            if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
                continue
            part = self.spark.read.parquet(f"{self.path}/level={level}/{name}")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def pending(self) -> DataFrame | None:
        """Items of any level that haven't been visited."""
        items, visited = self.load("pending"), self.load("visited")
        if items is None or visited is None:
            return items
        return items.join(visited.select("normalized_url"), "normalized_url", "left_anti").dropDuplicates(["normalized_url"])

    def set_meta(self, **values: str) -> None:
        old = self.meta() | values
        self.spark.createDataFrame(sorted(old.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(f"{self.path}/meta.new")
        jvm = self.spark._jvm
        new, at = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}") for n in ("meta.new", "meta"))
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(at, True)
        fs.rename(new, at)

    def meta(self) -> dict[str, str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return {}
        return {r["key"]: r["value"] for r in self.spark.read.schema("key string, value string").json(f"{self.path}/meta").collect()}
