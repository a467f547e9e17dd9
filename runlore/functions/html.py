"""HTML to text, as an Arrow-batched UDF over the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text is not part of the page text.
SILENT = ("script", "style", "template")


class _Text(HTMLParser):
    """Collects text nodes; a node ends at any tag, comment or declaration."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.open: list[str] = []
        self.silent = 0

    def _end_node(self):
        node = "".join(self.open).strip()
        if node:
            self.nodes.append(node)
        self.open.clear()

    def handle_starttag(self, tag, attrs):
        self._end_node()
        self.silent += tag in SILENT

    def handle_endtag(self, tag):
        self._end_node()
        if tag in SILENT and self.silent:
            self.silent -= 1

    def handle_startendtag(self, tag, attrs):
        self._end_node()

    def handle_data(self, data):
        if not self.silent:
            self.open.append(data)

    def handle_comment(self, data):
        self._end_node()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._end_node()
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])
            self._end_node()


def page_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    parser._end_node()
    return "\n".join(parser.nodes)


@F.pandas_udf(T.StringType())
def _html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(page_text)


def html_to_text(c: Column) -> Column:
    """Text nodes of the page, each stripped, one per line."""
    return _html_to_text(c)
