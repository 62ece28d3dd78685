"""Landed news pages -> raw article rows.

One Arrow-batched Python step finds the elements (HTML has no built-in expression); every
later rule - stripping, links, footers, dates, required fields - is a column expression.
Pages of plain markup are cut into tags by one pattern, all others go through the HTML parser;
both find the same items.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import with_absolute_date, with_relative_date
from ..sources.sites import Selector, SiteRule

VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FIELDS = ("headline", "date", "source", "link", "footer")
FOUND = "item_pos int, page_problem string, headline string, date string, source string, link string, footer string"


def _fits(selector: Selector, tag: str, attrs: dict[str, str | None]) -> bool:
    if tag != selector.tag or (selector.id is not None and attrs.get("id") != selector.id):
        return False
    return set(selector.classes) <= set((attrs.get("class") or "").split())


class _Finder(HTMLParser):
    """Collects one record per item element; unclosed tags end with their ancestor."""

    def __init__(self, rule: SiteRule):
        super().__init__(convert_charrefs=True)
        self.rule = rule
        self.open: list[tuple[str, dict]] = []
        self.items: list[dict] = []
        self.active: list[tuple[int, dict]] = []  # (depth of the item element, record)
        self.texts: list[tuple[int, dict, str]] = []  # (depth, record, field) being read

    def _matches(self, selector: Selector, tag: str, attrs: dict) -> bool:
        if not _fits(selector, tag, attrs):
            return False
        wanted = list(selector.inside)
        for outer_tag, outer_attrs in self.open:
            if wanted and _fits(wanted[0], outer_tag, outer_attrs):
                wanted.pop(0)
        return not wanted

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attrs = dict(attrs)
        depth = len(self.open)
        for _, record in self.active:
            for name, (selector, attribute) in self.rule.fields.items():
                if name not in record and self._matches(selector, tag, attrs):
                    if attribute is None:
                        record[name] = ""
                        if tag not in VOID_TAGS:
                            self.texts.append((depth, record, name))
                    else:
                        record[name] = attrs.get(attribute) or ""
        if self._matches(self.rule.item, tag, attrs) and tag not in VOID_TAGS:
            record: dict = {}
            self.items.append(record)
            self.active.append((depth, record))
        if tag not in VOID_TAGS:
            self.open.append((tag, attrs))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if depth is None:
            return
        del self.open[depth:]
        self.active = [entry for entry in self.active if entry[0] < depth]
        self.texts = [entry for entry in self.texts if entry[0] < depth]

    def handle_data(self, data: str) -> None:
        if self.texts and not (self.open and self.open[-1][0] in ("script", "style")):
            for _, record, name in self.texts:
                record[name] += data


_BLANK = r"[ \t\r\n]"
_VALUE = r"""[^"<>&]*(?:&\#?[a-zA-Z0-9]+;[^"<>&]*)*"""
_ATTRIBUTES = rf"""(?:{_BLANK}+[a-z][-a-z0-9]*(?:="{_VALUE}")?)*"""
_ATTRIBUTE = re.compile(r"""([a-z][-a-z0-9]*)(?:="([^"]*)")?""")
#: Elements whose content is read by other rules than tags and text.
_RAW = "script|style|textarea|xmp|iframe|noembed|noframes|noscript|plaintext|svg|math"
#: A tag, or something without effect on items (comment, doctype, script, style), with the text after it; else one character.
_PLAIN = re.compile(
    rf"""(?:<(?!/?(?:{_RAW})[ \t\r\n/>]|title(?!>[^<]*</title>))(/?)([a-z][a-z0-9]*)({_ATTRIBUTES}){_BLANK}*(/?)>"""
    rf"""|<!--[ \w][^<>-]*-->|<!(?:doctype|DOCTYPE) html>"""
    rf"""|<(?P<raw>script|style){_ATTRIBUTES}>[^<]*(?:<(?!/?[sS]|!)[^<]*)*</(?P=raw)>|\A)([^<]*)|(.)""",
    re.DOTALL,
)
_PIECE = re.compile(r"(<[^<>]*>)")
_MARK = "\x01"
#: Forms kept per site and task; they are dropped when there are more.
FORMS = 1000


class _Plain:
    """The items of plain pages of one site, as ``_Finder`` finds them."""

    def __init__(self, rule: SiteRule):
        self.item = rule.item
        self.fields: dict[str, list[tuple[str, Selector, str | None]]] = {}
        for name, (selector, attribute) in rule.fields.items():
            self.fields.setdefault(selector.tag, []).append((name, selector, attribute))
        tags = [rule.item.tag, *self.fields, *(outer.tag for s in (rule.item, *(f[0] for f in rule.fields.values())) for outer in s.inside)]
        self.usable = not set(tags) & set(_RAW.split("|"))
        #: Attributes that are read: their values and the texts differ from page to page, the rest is a page's form.
        self.read = sorted({f' {attribute}="' for _, attribute in rule.fields.values() if attribute} - {' class="', ' id="'})
        self.forms: dict[str, list[list[tuple[str, list[int | str]]]] | None] = {}

    @staticmethod
    def _matches(selector: Selector, tag: str, written: str, opened: list[tuple[str, str]]) -> bool:
        if not _fits_written(selector, tag, written):
            return False
        if not selector.inside:
            return True
        wanted = list(selector.inside)
        for outer_tag, outer_written in opened:
            if wanted and _fits_written(wanted[0], outer_tag, outer_written):
                wanted.pop(0)
        return not wanted

    def items(self, html: str) -> list[dict] | None:
        """One record per item, or None where the page has more than plain markup.

        Which texts and values make up a record depends on a page's form alone, so that is found
        once per form, on a page of marks.
        """
        pieces = _PIECE.split(html)
        tags, slots = pieces[1::2], pieces[0::2]
        form = "".join(tags)
        if _MARK in html or html.count("<") != len(tags):
            return self.walk(html)
        for start in self.read:
            if start in form:
                segments = form.split(start)
                for at in range(1, len(segments)):
                    value, quote, rest = segments[at].partition('"')
                    if "&" in value or ">" in value:
                        return self.walk(html)
                    slots.append(value)
                    segments[at] = quote + rest
                form = start.join(segments)
        if form not in self.forms:
            if len(self.forms) >= FORMS:
                self.forms.clear()
            self.forms[form] = self._parts(form, len(slots))
        parts = self.forms[form]
        if parts is None:
            return None
        items = []
        for fields in parts:
            record = {}
            for name, made_of in fields:
                if len(made_of) == 1 and type(made_of[0]) is int:
                    text = slots[made_of[0]]
                    record[name] = unescape(text) if "&" in text else text
                else:
                    record[name] = "".join([unescape(slots[part]) if type(part) is int else part for part in made_of])
            items.append(record)
        return items

    def _parts(self, form: str, n_slots: int) -> list[list[tuple[str, list[int | str]]]] | None:
        """Per item and field the numbers of its slots, or fixed text."""
        if "\0" in form:
            return None
        marks = [f"{_MARK}{i}{_MARK}" for i in range(n_slots)]
        pieces = _PIECE.split(form)
        pieces[0::2] = marks[: len(pieces[0::2])]
        at = len(pieces[0::2])
        tags = "\0".join(pieces[1::2])
        for start in self.read:
            segments = tags.split(start)
            tags = segments[0] + "".join(start + mark + rest for mark, rest in zip(marks[at:], segments[1:]))
            at += len(segments) - 1
        pieces[1::2] = tags.split("\0") if tags else []
        found = self.walk("".join(pieces))
        if found is None:
            return None
        return [[(name, [int(t) if i % 2 else t for i, t in enumerate(text.split(_MARK)) if i % 2 or t]) for name, text in record.items()] for record in found]

    def walk(self, html: str) -> list[dict] | None:
        """The records, tag by tag."""
        opened: list[tuple[str, str]] = []
        items: list[dict] = []
        active: list[tuple[int, dict]] = []
        texts: list[tuple[int, dict, str]] = []
        fields, item_tag = self.fields, self.item.tag
        for slash, tag, written, closed, _, text, other in _PLAIN.findall(html):
            if other or (slash and (written or closed)):
                return None
            ends = slash
            if tag and not slash:
                empty = tag in VOID_TAGS
                if active and tag in fields:
                    for _, record in active:
                        for name, selector, attribute in fields[tag]:
                            if name not in record and self._matches(selector, tag, written, opened):
                                if attribute is None:
                                    record[name] = ""
                                    if not empty:
                                        texts.append((len(opened), record, name))
                                else:
                                    record[name] = _attributes(written).get(attribute) or ""
                if tag == item_tag and not empty and self._matches(self.item, tag, written, opened):
                    record = {}
                    items.append(record)
                    active.append((len(opened), record))
                if not empty:
                    opened.append((tag, written))
                    ends = closed
            if ends:
                depth = len(opened) - 1
                while depth >= 0 and opened[depth][0] != tag:
                    depth -= 1
                if depth >= 0:
                    del opened[depth:]
                    if active and active[-1][0] >= depth:
                        active = [entry for entry in active if entry[0] < depth]
                    if texts and texts[-1][0] >= depth:
                        texts = [entry for entry in texts if entry[0] < depth]
            if texts and text:
                read = unescape(text) if "&" in text else text
                for _, record, name in texts:
                    record[name] += read
        return items


def _attributes(written: str) -> dict[str, str]:
    found = dict(_ATTRIBUTE.findall(written))
    return {name: unescape(value) for name, value in found.items()} if "&" in written else found


def _fits_written(selector: Selector, tag: str, written: str) -> bool:
    if tag != selector.tag:
        return False
    return (not selector.classes and selector.id is None) or _fits(selector, tag, _attributes(written))


def _with_text_escaped(html: str, references: Sequence[str]) -> str:
    """The page with an escape for every ampersand that starts none of the references."""
    return re.sub(rf"&(?!(?:{'|'.join(map(re.escape, references))});)", "&amp;", html)


def find_items(html: str, rule: SiteRule) -> list[dict]:
    return [record for _, problem, record in _page_items(html, rule) if problem is None]


def _page_items(html: str | None, rule: SiteRule | None, plain: _Plain | None = None) -> list[tuple[int, str | None, dict]]:
    """(position, problem, record) of a page's items; a page with none, or with a part that can't be read, adds a reject at -1."""
    if html is None or rule is None:
        return [(-1, "no page" if html is None else "unknown site", {})]
    if rule.references is not None:
        html = _with_text_escaped(html, rule.references)
    problem, records = None, plain.items(html) if plain and plain.usable else None
    if records is None:
        finder = _Finder(rule)
        try:
            finder.feed(html)
            finder.close()
        except AssertionError:  # what the parser raises for a malformed declaration; items before it stay
            problem = "unreadable page"
        records = finder.items
    items = [(at, None, record) for at, record in enumerate(records)]
    if not items and problem is None:
        problem = "no items"
    return [*items, (-1, problem, {})] if problem else items


def _find(pages: DataFrame, rules: Sequence[SiteRule]) -> DataFrame:
    """One row per item element, and one per page without or with unreadable ones, with the page's other columns carried along."""
    carried = [c for c in pages.columns if c != "html"]
    carried_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")
    by_site = {rule.name: rule for rule in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = {rule.name: _Plain(rule) for rule in rules}
        for batch in batches:
            source, position, problems, found = [], [], [], []
            for row, (site, html) in enumerate(zip(batch.column("site").to_pylist(), batch.column("html").to_pylist())):
                for pos, problem, record in _page_items(html, by_site.get(site), plain.get(site)):
                    source.append(row)
                    position.append(pos)
                    problems.append(problem)
                    found.append(record)
            rows = batch.select(carried).take(pa.array(source, pa.int32()))
            texts = [pa.array([record.get(name) for record in found], pa.string()) for name in FIELDS]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(position, pa.int32()), pa.array(problems, pa.string()), *texts],
                [*carried, "item_pos", "page_problem", *FIELDS],
            )

    return pages.mapInArrow(run, f"{carried_ddl}, {FOUND}")


def _link(rule: SiteRule) -> Column:
    link = F.col("link")
    if rule.link_style == "page":
        return F.col("url")
    if rule.link_style == "absolute":
        return T.absolute_link(link, rule.link_root)
    if rule.link_style == "dotted":
        return T.dot_link(link, rule.link_root)
    return link


def _of(rules: Sequence[SiteRule]) -> Column:
    return F.col("site").isin([rule.name for rule in rules])


def _headline(rules: Sequence[SiteRule]) -> Column:
    """Stripped, cleaned or as written, by site."""
    cleaned = [rule for rule in rules if rule.strip_headline and rule.drop_escaped_newlines]
    written = [rule for rule in rules if not rule.strip_headline]
    stripped = F.when(_of(written), F.col("headline")).otherwise(T.strip(F.col("headline"))) if written else T.strip(F.col("headline"))
    return F.when(_of(cleaned), T.clean_headline(F.col("headline"))).otherwise(stripped) if cleaned else stripped


def _source(rule: SiteRule) -> Column:
    if "footer" in rule.fields:
        return T.footer_parts(F.col("footer"))[0]
    return F.lit(rule.constant_source) if rule.constant_source else F.col("source")


def _date_text(rule: SiteRule) -> Column:
    if "footer" in rule.fields:
        return T.footer_parts(F.col("footer"))[1]
    if rule.date_kind == "none":
        return F.lit("")
    return T.strip(F.col("date")) if rule.date_kind == "absolute" else F.col("date")


def _problem(rules: Sequence[SiteRule]) -> Column:
    """What an item lacks; fields are compared once for all sites that need them."""
    needed = {name: [rule for rule in rules if name in rule.required] for name in FIELDS}
    missing = reduce(lambda a, b: a | b, (_of(of) & F.col(name).isNull() for name, of in needed.items() if of), F.lit(False))
    problem = F.when(missing, "missing element")
    return problem.when(_of(needed["link"]) & (F.col("link") == ""), "missing link") if needed["link"] else problem


def extract_articles(pages: DataFrame, rules: Sequence[SiteRule], as_of: str = "as_of") -> DataFrame:
    """All items of landed pages, with ``problem`` null for usable articles.

    ``pages`` has site (the rule's name), url, html and, for relative and absolute dates,
    the scrape time. Pages are read once whatever the number of sites, and a site without
    pages adds nothing. A page that is null, of a site without a rule, without an item, or
    malformed is a row of its own with that problem; items read before a malformed part stay.
    """

    def per_site(column: Callable[[SiteRule], Column]) -> Column:
        chosen = F
        for rule in rules:
            chosen = chosen.when(F.col("site") == rule.name, column(rule))
        return chosen

    items = _find(pages, rules).withColumns(
        {
            "headline": _headline(rules),
            "source": per_site(_source),
            "article_link": per_site(_link),
            "date_text": per_site(_date_text),
            "problem": _problem(rules),
        }
    )
    # Each kind of date reads its own sites' text; the others stay as written.
    written = [rule for rule in rules if rule.date_kind in ("raw", "none")]
    outcomes = [(F.col("date_text"), F.lit("ok"), written)] if written else []
    relative = [rule for rule in rules if rule.date_kind == "relative"]
    if relative:
        items = items.withColumn("__text", F.when(_of(relative), F.col("date_text")))
        items = with_relative_date(items, "__text", as_of, "__rel")
        outcomes.append((F.col("__rel"), F.col("__rel_status"), relative))
    absolute = [rule for rule in rules if rule.date_kind == "absolute"]
    for i, fmt in enumerate(sorted({rule.date_format for rule in absolute})):
        same = [rule for rule in absolute if rule.date_format == fmt]
        items = items.withColumn("__text", F.when(_of(same), F.col("date_text")))
        items = with_absolute_date(items, "__text", fmt, as_of, f"__abs{i}")
        outcomes.append((F.col(f"__abs{i}"), F.col(f"__abs{i}_status"), same))

    date, status = F, F
    for value, state, of in outcomes:
        date, status = date.when(_of(of), value), status.when(_of(of), state)
    bad_date = F.when(F.col("__status") == "reject", "unreadable date")
    helpers = [c for c in items.columns if c.startswith("__")]
    return (
        items.withColumns({"date_posted": date, "__status": status})
        .withColumn("problem", F.coalesce("page_problem", "problem", bad_date))
        .drop("page_problem", "date", "link", "footer", "date_text", "__status", *helpers)
    )


def extract_site(pages: DataFrame, rule: SiteRule, as_of: str = "as_of") -> DataFrame:
    """Items of one site's pages."""
    return extract_articles(pages.withColumn("site", F.lit(rule.name)), [rule], as_of)


def usable(items: DataFrame) -> DataFrame:
    return items.where(F.col("problem").isNull()).drop("problem")


def rejected(items: DataFrame) -> DataFrame:
    return items.where(F.col("problem").isNotNull())


def site_requests(universe: DataFrame, rules: Sequence[SiteRule]) -> DataFrame:
    """Fan-out: one row per ticker and site, with the page address to land."""
    visits = F.array(
        *(
            F.struct(
                F.lit(order).alias("visit_order"),
                F.lit(rule.name).alias("site"),
                F.replace(F.lit(rule.url), F.lit("{ticker}"), F.col("ticker")).alias("url"),
            )
            for order, rule in enumerate(rules)
        )
    )
    return universe.select("ticker", F.inline(visits))
