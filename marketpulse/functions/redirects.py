"""Where a redirect page points to, read off the parsed page.

Comments, character references, attribute order and quoting are the parser's business, so
this is an Arrow-batched step and not a pattern over the page's text.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The call that redirects, and the schemes of its argument.
CALL = "window.location.replace("
SCHEMES = ("http://", "https://")


class _RedirectPage(HTMLParser):
    """The link of the first anchor marked nofollow, and the texts of all scripts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.link: str | None = None
        self.seen = False
        self.scripts: list[str] = []
        self.in_script = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(reversed(attrs))  # the first of equal attributes counts
        if tag == "a" and not self.seen and "nofollow" in (named.get("rel") or "").split():
            self.seen, self.link = True, named.get("href")
        self.in_script = tag == "script"
        if self.in_script:
            self.scripts.append("")

    def handle_endtag(self, tag: str) -> None:
        self.in_script = False

    def handle_data(self, data: str) -> None:
        if self.in_script:
            self.scripts[-1] += data


def _argument(script: str) -> str | None:
    """The first quoted address on one line that the script hands to the redirecting call."""
    at = script.find(CALL)
    while at >= 0:
        at += len(CALL)
        line = script[at:].split("\n", 1)[0]
        if line[:1] in ("'", '"') and line[1:].startswith(SCHEMES):
            ends = [end for end in (line.find("')", 1), line.find('")', 1)) if end > 0]
            if ends:
                return line[1 : min(ends)]
        at = script.find(CALL, at)
    return None


def target_of(html: str | None) -> str | None:
    """The link of the first nofollow anchor; without one, the decoded argument of a script's redirect. ``+`` stays as it is."""
    if not html:
        return None
    page = _RedirectPage()
    try:
        page.feed(html)
        page.close()
    except AssertionError:  # a malformed declaration; what stands before it counts
        pass
    if page.link:
        return page.link
    found = next((x for x in map(_argument, page.scripts) if x), None)
    return unquote(found) if found else None


@F.arrow_udf(StringType())
def _targets(pages: pa.Array) -> pa.Array:
    return pa.array([target_of(page.as_py()) for page in pages], pa.string())


def redirect_target(body: Column) -> Column:
    """Where a redirect page points to, or null."""
    return _targets(body)
