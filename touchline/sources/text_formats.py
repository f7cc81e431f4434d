"""CSV with stated schemas, lookup files, HTML tables, and reports as files."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.scalars import fee_parts


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """CSV with a header by a stated schema; values that do not fit are null."""
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")


def read_lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A two-column lookup; a key given twice is an error when rows are read."""
    from touchline.operators.joins import require_unique

    return require_unique(read_csv(spark, path, f"{key} string, {value} string"), [key])


def rename_columns(df: DataFrame, names: Mapping[str, str], keep_others: bool = False) -> DataFrame:
    """Raw to canonical names; ValueError where two raw columns would come out alike."""
    out = [(c, names.get(c, c)) for c in df.columns if keep_others or c in names]
    targets = [t for _, t in out]
    twice = sorted({t for t in targets if targets.count(t) > 1})
    if twice:
        raise ValueError(f"columns that clash: {twice}")
    return df.select(*[F.col(f"`{c}`").alias(t) for c, t in out])


def plain_name(name: str) -> str:
    """A column name fit for SQL: '% Won' -> 'pct_won', 'Gls/90' -> 'gls_per_90', '+/-' -> 'plus_minus', '#OPA' -> 'num_opa'."""
    for mark, word in (("+/-", "plus_minus"), ("%", "pct"), ("/90", "per_90"), ("/", "per"), ("#", "num")):
        name = name.replace(mark, f" {word} ")
    return "_".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in name.lower()).split())


def without_suffix_copies(columns: Sequence[str], suffixes: Sequence[str], preserve: Sequence[str] | Mapping[str, str] = ()) -> dict[str, str | None]:
    """What becomes of each column: a suffixed copy goes (None) where the bare one exists, else takes its name; the longest
    suffix counts. ``preserve`` keeps columns, as they are or, given names, under those."""
    have, out = set(columns), {}
    kept = dict(preserve) if isinstance(preserve, Mapping) else {c: c for c in preserve}
    for c in columns:
        hit = next((s for s in sorted(suffixes, key=len, reverse=True) if c.endswith(s)), None)
        bare = c[: -len(hit)] if hit else c
        out[c] = kept[c] if c in kept else c if hit is None else None if bare in have else bare
    return out


class _Tables(HTMLParser):
    """Cells of every table row, with the heading the table stands under."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, str, list[str]]] = []
        self.table, self.heading, self.in_heading = -1, "", False
        self.cells: list[str] | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("h1", "h2", "h3"):
            self.in_heading, self.heading = True, ""
        elif tag == "table":
            self.table += 1
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("h1", "h2", "h3"):
            self.in_heading = False
        elif tag in ("td", "th") and self.cell is not None and self.cells is not None:
            self.cells.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.cells is not None:
            if self.cells:
                self.rows.append((max(self.table, 0), self.heading.strip(), self.cells))
            self.cells = None

    def handle_data(self, data: str) -> None:
        if self.in_heading:
            self.heading += data
        elif self.cell is not None:
            self.cell.append(data)


def html_rows(html: str | None) -> list[tuple[int, str, list[str]]]:
    """(table number, heading, cells) of every table row of a page; nothing for null pages or pages without tables."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return parser.rows


def html_table_rows(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """(page_id, table_no, heading, row_no, cells) over Arrow batches."""
    kind = dict(pages.dtypes)[page_id]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, t, h, i, cells) for p, x in zip(part[page_id], part[html]) for i, (t, h, cells) in enumerate(html_rows(x))]
            yield pd.DataFrame(rows, columns=[page_id, "table_no", "heading", "row_no", "cells"])

    return pages.select(page_id, html).mapInPandas(run, f"{page_id} {kind}, table_no int, heading string, row_no int, cells array<string>")


@dataclass
class _Node:
    """An element of a page: tag, attributes, children and texts in their order."""

    tag: str
    attrs: dict[str, str]
    parts: list = field(default_factory=list)

    def all(self, tag: str, css: str = "") -> Iterator[_Node]:
        """Descendants of a tag (any for '') and class, in page order."""
        for p in self.parts:
            if isinstance(p, _Node):
                if tag in ("", p.tag) and (not css or css in p.attrs.get("class", "").split()):
                    yield p
                yield from p.all(tag, css)

    def text(self) -> str:
        pieces: list[str] = []
        stack: list = [self]
        while stack:
            p = stack.pop()
            if isinstance(p, _Node):
                stack.extend(reversed(p.parts))
            else:
                pieces.append(p)
        return " ".join(" ".join(pieces).replace("\u00a0", " ").split())


class _Page(HTMLParser):
    """A tree of a page that forgives elements left open or closed twice."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    #: Elements that end where the like begins, and those inside which that looks no further. Fixed values.
    REPEATED = {"tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "li": {"ul", "ol"}, "p": {"div", "td", "body"}}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Node("", {})]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k].tag
            if name in self.REPEATED.get(tag, ()) or tag not in self.REPEATED:
                break
            if name == tag or tag in ("td", "th") and name in ("td", "th"):
                del self.open[k:]
                break
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].parts.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


ARRIVAL = "player_name string, player_age string, player_position string, from_club string, to_club string, fee_text string, value_text string"


def page_arrivals(html: str | None) -> list[tuple[str, ...]]:
    """The arrivals of every club on a page of transfers, as (player, age, position, former club, club, fee, value) texts.

    A club is a box whose heading names it (not a record or a season); of its tables those count whose first heading
    is 'In'; a row counts where it links a player. The fee is the last cell. Missing cells are ''.
    """
    page = _Page()
    page.feed(html or "")
    page.close()
    out = []
    for box in page.open[0].all("div", "box"):
        heading = next(box.all("h2"), None)
        club = heading.text() if heading else ""
        if not club or club == "Transfer record" or "season" in club.lower():
            continue
        for table in (t for part in box.all("div", "responsive-table") for t in part.all("table")):
            heads = [th.text() for head in table.all("thead") for th in head.all("th")]
            if not heads or heads[0] != "In":
                continue
            for row in (r for body in table.all("tbody") for r in body.all("tr")):
                link = next((a for td in row.all("td") for a in td.all("a") if "/profil/spieler/" in a.attrs.get("href", "")), None)
                cells = [p for p in row.parts if isinstance(p, _Node) and p.tag == "td"]
                if link is None or not cells:
                    continue
                cell = lambda css: next((td.text() for td in row.all("td", css)), "")  # noqa: B023, E731
                out.append((link.text(), cell("alter-transfer-cell"), cell("pos-transfer-cell"), cell("verein-flagge-transfer-cell"), club, cells[-1].text(), cell("mw-transfer-cell")))
    return out


def arrivals(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """A row for each arrival of each page with its fee and market value read (``fee_parts``); pages in Arrow batches."""
    kind = dict(pages.dtypes)[page_id]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *a) for p, x in zip(part[page_id], part[html]) for a in page_arrivals(x)]
            yield pd.DataFrame(rows, columns=[page_id, *[c.split()[0] for c in ARRIVAL.split(", ")]])

    raw = pages.select(page_id, html).mapInPandas(run, f"{page_id} {kind}, {ARRIVAL}")
    fee, transfer_type = fee_parts(F.col("fee_text"))
    value, _ = fee_parts(F.col("value_text"))
    return raw.withColumns({"transfer_fee_eur": fee, "transfer_type": transfer_type, "market_value_eur": value}).drop("fee_text", "value_text")


def write_report(df: DataFrame, path: str, most_rows: int = 1000) -> None:
    """A small result as a Markdown table on the driver; ValueError where it has more than ``most_rows`` rows."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report of more than {most_rows} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
