"""HTML → markdown in one pass over the tag stream, and HTML metadata.

Own rules (the reference delegates to third-party extractors).  A converter walks
the tokens of the standard parser with a stack of open elements, so a removed
block ends where its own tag does, however deep the same tags nest inside:
scripts, styles and the document head go; for full documents the boilerplate
blocks (nav, aside, header, footer, form, ad containers) go too; headings, links,
images, emphasis, code, numbered and nested lists, tables with a separator line
and preformatted blocks with their indentation become markdown; other tags are
dropped, character references decoded and whitespace normalized.  Texts pass as
Arrow batches.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, bind, replace_each

# Elements without an end tag, and those that an open one ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ENDED_BY = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Elements that an implied end does not reach out of.
SCOPES = {"ul", "ol", "table", "dl", "select", "div", "section", "article", "blockquote", "body"}
REMOVED = {"script", "style", "noscript", "head", "template"}
BOILERPLATE = {"nav", "aside", "header", "footer", "form"}
AD_CLASS = re.compile(r"\b(ad|ads|advert|sidebar|cookie|banner)\b", re.IGNORECASE)
BLOCKS = {"p", "div", "ul", "ol", "table", "section", "article", "main", "body", "html", "blockquote", "figure", "dl"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}


#: The same whitespace in the standard library's notation.
SPACE = re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: f"\\u{int(m.group(1), 16):04x}", WS)


class _Frame:
    """An open element: what it holds so far, and what its end makes of it."""
    __slots__ = ("tag", "parts", "attrs", "number", "rows", "removed")

    def __init__(self, tag, attrs=None, removed=False):
        self.tag, self.parts, self.attrs, self.number, self.rows, self.removed = tag, [], attrs or {}, 0, [], removed


class Converter(HTMLParser):
    """One text's markdown.  Kept pieces (preformatted text, list indentation)
    stand outside the whitespace rules by a character that the text lacks."""

    def __init__(self, document: bool, mark: str):
        super().__init__(convert_charrefs=True)
        self.document, self.mark, self.kept = document, mark, []
        self.stack = [_Frame("")]

    def keep(self, piece: str) -> str:
        self.kept.append(piece)
        return f"{self.mark}{len(self.kept) - 1}{self.mark}"

    def _goes(self, tag: str, attrs: dict) -> bool:
        if tag in REMOVED:
            return True
        return self.document and (tag in BOILERPLATE or (tag == "div" and bool(AD_CLASS.search(attrs.get("class") or ""))))

    def _inside(self, *tags: str) -> _Frame | None:
        return next((f for f in reversed(self.stack) if f.tag in tags), None)

    def handle_starttag(self, tag, attrs):
        attrs = dict(reversed(attrs))  # of repeated attributes the first counts
        if tag == "body" and (head := self._inside("head")) is not None:
            self._end_through(head)
        top = self.stack[-1]
        if top.removed:
            if tag not in VOID:
                self.stack.append(_Frame(tag, removed=True))
            return
        self._imply_ends(tag)
        top = self.stack[-1]
        if tag in VOID:
            if tag == "br":
                top.parts.append("\n")
            elif tag == "hr":
                top.parts.append("\n\n---\n\n")
            elif tag == "img" and attrs.get("src") is not None:
                top.parts.append(f"![]({attrs['src']})")
            return
        frame = _Frame(tag, attrs, self._goes(tag, attrs))
        if tag == "ol":
            start = attrs.get("start") or ""
            frame.number = int(start) - 1 if re.fullmatch(r"-?[0-9]{1,9}", start) else 0
        if tag == "li" and not frame.removed:
            lists = [f for f in self.stack if f.tag in ("ul", "ol")]
            if lists:
                lists[-1].number += 1
            bullet = f"{lists[-1].number}. " if lists and lists[-1].tag == "ol" else "- "
            top.parts.append("\n" + (self.keep("  " * (len(lists) - 1)) if len(lists) > 1 else "") + bullet)
        self.stack.append(frame)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _imply_ends(self, tag: str) -> None:
        ended, outer = ENDED_BY.get(tag, ()), None
        for f in reversed(self.stack):
            if f.tag in SCOPES:
                break
            outer = f if f.tag in ended else outer
        if outer is not None:
            self._end_through(outer)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag(tag, [])
        frame = self._inside(tag) if tag not in VOID else None
        if frame is not None and not (self.stack[-1].removed and not frame.removed and tag not in BLOCKS):
            self._end_through(frame, True)

    def _end_through(self, frame: _Frame, named: bool = False) -> None:
        while True:
            last = self.stack.pop()
            self._ended(last, named and last is frame)
            if last is frame:
                return

    def handle_data(self, data):
        if not self.stack[-1].removed:
            self.stack[-1].parts.append(data)

    def _ended(self, f: _Frame, named: bool = False) -> None:
        """Hand what an element holds to the one around it.  Headings, links,
        emphasis and code without an end tag of their own are plain text."""
        top = self.stack[-1]
        if f.removed:
            return
        inner = "".join(f.parts)
        if f.tag == "pre":
            raw = self._whole(inner).strip("\n")
            inner = "\n\n" + self.keep(f"```\n{raw}\n```") + "\n\n"
        elif self._inside("pre") is not None:
            pass
        elif named and f.tag in HEADINGS:
            inner = f"\n\n{HEADINGS[f.tag]}{inner}\n\n"
        elif named and f.tag == "a" and f.attrs.get("href") is not None:
            inner = f"[{inner}]({f.attrs['href']})"
        elif named and f.tag in MARKS:
            inner = MARKS[f.tag] + inner + MARKS[f.tag]
        elif named and f.tag == "code":
            inner = f"`{inner}`"
        elif f.tag in ("td", "th"):
            row = self._inside("tr", "table")
            if row is not None:
                row.rows.append(re.sub(rf"[{SPACE}]+", " ", inner).strip().replace("|", "\\|"))
                return
        elif f.tag == "tr":
            table = self._inside("table")
            if table is not None:
                if f.rows:
                    table.rows.append(f.rows)
                return
        elif f.tag == "table" and f.rows:
            rows = [r if isinstance(r, list) else [r] for r in f.rows]
            if self._inside("table") is not None:  # a table in a cell: its rows in a line
                inner = inner + " " + "; ".join(" ".join(r) for r in rows)
            else:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                inner = inner + "\n\n" + "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]]) + "\n\n"
        elif f.tag in BLOCKS and not (f.tag in ("ul", "ol") and self._inside("li") is not None):
            inner = f"\n\n{inner}\n\n"
        top.parts.append(inner)

    def _whole(self, text: str) -> str:
        return re.sub(f"{self.mark}([0-9]+){self.mark}", lambda m: self.kept[int(m.group(1))], text) if self.kept else text

    def markdown(self) -> str:
        while len(self.stack) > 1:
            self._ended(self.stack.pop())
        text = "".join(self.stack[0].parts)
        text = re.sub("[ \t\xa0]{2,}|[\t\xa0]", " ", text)
        text = "\n".join(line.strip(" ") for line in text.split("\n"))
        text = re.sub("\n{3,}", "\n\n", text)
        return self._whole(text.strip())


def convert(html: str, document: bool) -> str:
    """Markdown of one text."""
    mark = next((chr(c) for c in range(0xE000, 0xF900) if chr(c) not in html), "\uf8ff")
    parser = Converter(document, mark)
    parser.feed(html)
    parser.close()
    return parser.markdown()


def html_to_markdown(html: Column, is_document: Column) -> Column:
    """Main content of a full document, or all of a fragment, as markdown; null
    stays null."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(texts, documents):
        return pd.Series([None if t is None else convert(t, bool(d)) for t, d in zip(texts, documents)], dtype=object)
    return pandas_udf(run, "string")(html, is_document)


# Entities decoded (ampersand last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&")]

def decode_entities(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


NUMERIC_RE = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"


def decode_numeric(c: Column) -> Column:
    """Decimal and hexadecimal character references; references to no character
    stay as they are."""
    def char(ref):
        body = F.regexp_extract(ref, r"&#([^;]+);", 1)
        n = F.when(F.lower(body).startswith("x"), F.conv(F.substring(body, 2, 6), 16, 10)).otherwise(body).cast("long")
        fine = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    return bind(c, lambda x: F.when(x.contains("&#"), replace_each(x, NUMERIC_RE, char)).otherwise(x))


# ------------------------------------------------------------ metadata

META_FIELDS = [
    ("description", "description"), ("author", "author"), ("sitename", "og:site_name"),
    ("date", "article:published_time"), ("license", "license"), ("pagetype", "og:type"),
]


def _meta_content(html: Column, name: str) -> Column:
    """Content of the first <meta> with the name, in either attribute order."""
    own = r"""\b(?:name|property)\s*=\s*["']""" + name.replace(".", r"\.") + r"""["']"""
    value = r"""\bcontent\s*=\s*["']([^"']*)["']"""
    return F.coalesce(F.nullif(F.regexp_extract(html, rf"(?is)<meta\b[^>]*{own}[^>]*{value}", 1), F.lit("")),
                      F.regexp_extract(html, rf"(?is)<meta\b[^>]*{value}[^>]*{own}", 1))


def _clean(v: Column) -> Column:
    t = F.regexp_replace(decode_entities(decode_numeric(v)), f"^[{WS}]+|[{WS}]+$", "")
    return F.when(t != "", t)


def _all_contents(html: Column, name: str) -> Column:
    """Contents of all <meta> with the name, in either attribute order."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), 1),
                    lambda t: t.rlike(r"""(?is)\b(?:name|property)\s*=\s*["']""" + name + r"""["']"""))
    return F.transform(tags, lambda t: F.regexp_extract(t, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1))


def _keywords(html: Column) -> Column:
    """Comma-separated ``keywords`` and then every ``article:tag``."""
    return F.concat(F.flatten(F.transform(_all_contents(html, "keywords"), lambda k: F.split(k, ","))), _all_contents(html, "article:tag"))


def _json_list(values: Column) -> Column:
    """JSON array of the distinct non-blank values, null without one."""
    some = F.array_distinct(F.filter(F.transform(values, _clean), lambda v: v.isNotNull()))
    return F.when(F.size(some) > 0, F.to_json(some))


def html_metadata(html: Column) -> Column:
    """Map of title, lang, meta fields, and tags and categories as JSON arrays;
    blank values omitted."""
    title = _clean(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))
    lang = _clean(F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang\s*=\s*["']([^"']*)["']""", 1))
    pairs = [("tags", _json_list(_keywords(html))), ("categories", _json_list(_all_contents(html, "article:section"))), ("title", title), ("lang", lang)] + [(k, _clean(_meta_content(html, n))) for k, n in META_FIELDS]
    m = F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    return F.map_filter(m, lambda k, v: v.isNotNull())


