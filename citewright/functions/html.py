"""Main text of a whole HTML document by an own rule: block texts outside of furniture, one blank line between blocks."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citewright.functions.text import is_document, strip_fragment

#: Elements whose text is no content, and elements that end a block.
SKIP = frozenset("script style noscript template nav footer aside form header head button select svg iframe".split())
BLOCK = frozenset("p div section article main li ul ol h1 h2 h3 h4 h5 h6 blockquote pre tr td th dd dt br figcaption body".split())


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.skipped, self.blocks, self.run = 0, [], [], []

    def flush(self):
        block = " ".join("".join(self.run).split())
        if block:
            self.blocks.append(block)
        self.run = []

    def handle_starttag(self, tag, attrs):
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower().split()
        if tag in BLOCK or tag in SKIP:
            self.flush()
        if self.skipped or tag in SKIP or any(n in ("ad", "ads", "advert", "sidebar", "menu", "comments") for n in names):
            if tag not in ("br", "img", "hr", "meta", "link", "input"):
                self.skipped.append(tag)

    def handle_endtag(self, tag):
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.skipped:
            self.run.append(data)


def main_text(raw: str) -> str:
    parser = _Blocks()
    parser.feed(raw)
    parser.close()
    parser.flush()
    return "\n\n".join(parser.blocks)


@F.pandas_udf(StringType())
def _main(s: pd.Series) -> pd.Series:
    return s.map(main_text, na_action="ignore")


def clean_html(raw: Column) -> Column:
    """Documents by their blocks, and by the fragment rule if that leaves nothing; fragments by the fragment rule."""
    doc = is_document(raw)
    text = F.when(doc, _main(F.when(doc, raw)))
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(strip_fragment(raw))
