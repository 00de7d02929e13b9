"""Readable text of HTML pages with marked headings and paragraphs.

Tag soup needs a parser, so this runs in Arrow batches inside the tasks of the scan: no shuffle, a
row in and a row out. Of a batch, which may hold thousands of pages, a few are texts in Python at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

# Text written around the content of a tag, in order of precedence. A tag inside one
# of the same or an earlier precedence keeps its bare content.
TEMPLATES = {
    "h1": ("\n\n# ", " #\n\n"),
    "h2": ("\n\n## ", " ##\n\n"),
    "h3": ("\n\n### ", " ###\n\n"),
    "p": ("\n\n", "\n\n"),
    "br": ("\n", ""),
}
PRECEDENCE = {tag: i for i, tag in enumerate(TEMPLATES)}
DROPPED = {"script", "style"}
# Elements without content.
VOID = set("area base br col embed hr img input keygen link menuitem meta param source track wbr".split())


#: Pages whose texts are held at once.
ROWS = 64


class _Text(HTMLParser):
    """Text of the open elements, innermost last; closing an element hands its text to its parent.

    Tag soup is read as it comes: an element stays open until its own end tag or that of one of its
    ancestors.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = [("", [])]

    def handle_starttag(self, tag, attrs):
        self.open.append((tag, []))
        if tag in VOID:
            self._close()

    def handle_endtag(self, tag):
        if tag not in VOID and any(name == tag for name, _ in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        self.open[-1][1].append(data)

    def _close(self):
        name, parts = self.open.pop()
        if name in DROPPED:
            return
        text = "".join(parts)
        own = PRECEDENCE.get(name)
        if own is not None and not any(PRECEDENCE.get(tag, own + 1) <= own for tag, _ in self.open):
            before, after = TEMPLATES[name]
            text = before + text.strip() + after
        self.open[-1][1].append(text)

    def text(self) -> str:
        while len(self.open) > 1:
            self._close()
        lines = (line.strip() for line in "".join(self.open[0][1]).splitlines())
        return "\n".join(line for line in lines if line)


def html_to_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return parser.text()


def texts_of(batches: Iterator[pa.RecordBatch], out: str) -> Iterator[pa.RecordBatch]:
    """Batches with the text of each page in place of the last column, its html."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            *kept, pages = batch.slice(start, ROWS).columns
            texts = pa.array([html_to_text(h.as_py()) for h in pages], pa.string())
            yield pa.RecordBatch.from_arrays([*kept, texts], names=[*batch.schema.names[:-1], out])


def extract_text(pages: DataFrame, html: str, keep: list[str], out: str = "text") -> DataFrame:
    """``keep`` columns and the readable text of each page."""
    source = pages.select(*keep, html)
    schema = ", ".join([f"`{n}` {t}" for n, t in source.select(*keep).dtypes] + [f"`{out}` string"])
    return source.mapInArrow(lambda batches: texts_of(batches, out), schema)
