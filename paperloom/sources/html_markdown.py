"""HTML to Markdown with the standard library's parser: headings, paragraphs, lists, emphasis, links, images, tables, code."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import groupby
from urllib.parse import quote, unquote, urlsplit, urlunsplit

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "section", "article", "header", "footer", "nav", "main", "aside", "figure", "figcaption", "form", "address", "dl", "dt", "dd", "fieldset"}
_DROPPED = {"script", "style", "noscript", "template"}
_HEADINGS = {f"h{k}": k for k in range(1, 7)}
#: Elements nested deeper than this become siblings, so that no page exhausts the stack; no text is lost.
DEEPEST = 100
#: Eight and more tags without attributes and with nothing between, of elements whose content is parsed like any other.
_RUN = re.compile(r"(?:</?(?:" + "|".join(sorted(_BLOCK | set("a b blockquote del em i li ol s span strong table tbody td th thead tr u ul".split()), key=len, reverse=True)) + ")>){8,}")


class _Node:
    __slots__ = ("attrs", "children", "depth", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.depth = 0 if parent is None else parent.depth + 1


class _Tree(HTMLParser):
    """A forgiving tree: an end tag closes the nearest open element of its name, and everything opened since."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = _Node("", {}, None)
        self.beyond: list[str] = []  # open elements that are too deep to hold others

    def read(self, html: str) -> None:
        """The whole document. Runs of plain tags are cut without the parser, unless it is within a comment, a script or such."""
        at = 0
        for run in _RUN.finditer(html):
            first = html.index(">", run.start()) + 1
            self.feed(html[at:first])
            at = first
            if self.rawdata or self.cdata_elem is not None:
                break
            for tag, same in groupby(html[at + 1 : run.end() - 1].split("><")):
                n = len(list(same))
                if tag[0] == "/":
                    while n and self.beyond and self.beyond[-1] == tag[1:]:
                        self.beyond.pop()
                        n -= 1
                    for _ in range(n):
                        self.handle_endtag(tag[1:])
                else:
                    while n:
                        self.handle_starttag(tag, ())
                        n -= 1
                        if self.beyond and tag in _BLOCK and tag != "p":  # too deep to hold anything: one end of a paragraph stands for all
                            self.beyond += [tag] * n
                            n = 0
            at = run.end()
        self.feed(html[at:])
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th") and (open_ := self._open(tag, {"ul", "ol", "table", "tr"} - {tag})):
            self.now = open_.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag in _VOID:
            return
        if node.depth < DEEPEST:
            self.now = node
        else:
            self.beyond.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.now.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self.now))

    def handle_endtag(self, tag):
        if self.beyond:
            if tag in self.beyond:
                while self.beyond.pop() != tag:
                    pass
            return
        if open_ := self._open(tag, set()):
            self.now = open_.parent

    def handle_data(self, data):
        self.now.children.append(data)

    def _open(self, tag: str, within: set[str]) -> _Node | None:
        node = self.now
        while node.parent is not None and node.tag not in within:
            if node.tag == tag:
                return node
            node = node.parent
        return None


def _find(node: _Node, tag: str) -> _Node | None:
    for x in node.children:
        if isinstance(x, _Node):
            if x.tag == tag:
                return x
            if x.children and (found := _find(x, tag)):
                return found
    return None


def _text(node: _Node) -> str:
    return "".join(x if isinstance(x, str) else _text(x) for x in node.children)


def link_target(href: str) -> str | None:
    """A link's target, quoted anew; null if its scheme is not kept."""
    try:
        parts = urlsplit(href)
    except ValueError:
        return None
    if parts.scheme and parts.scheme.lower() not in ("http", "https", "file"):
        return None
    return urlunsplit(parts._replace(path=quote(unquote(parts.path))))


class _Writer:
    def inline(self, node: _Node | str, plain: bool = False) -> str:
        if isinstance(node, str):
            return re.sub(r"\s+", " ", node)
        body = "".join(self.inline(x, plain) for x in node.children)
        tag = node.tag
        if tag in _DROPPED:
            return ""
        if tag == "br":
            return "  \n"
        if tag in ("b", "strong", "i", "em", "code", "del", "s") and body.strip():
            mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}[tag]
            lead, tail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
            return f"{lead}{mark}{body.strip()}{mark}{tail}"
        if tag == "a":
            text = body.strip()
            href = node.attrs.get("href", "").strip()
            target = link_target(href) if href else None
            if not text or target is None:
                return body if text else ""
            if text == href and not node.attrs.get("title"):
                return f"<{href}>"
            title = node.attrs.get("title")
            return f"[{text}]({target}" + (' "' + title.replace('"', '\\"') + '"' if title else "") + ")"
        if tag == "img":
            alt, src = node.attrs.get("alt", ""), node.attrs.get("src", "")
            if plain:
                return alt
            if src.startswith("data:"):
                src = src.split(",")[0] + "..."
            title = node.attrs.get("title")
            return f"![{alt}]({src}" + (' "' + title.replace('"', '\\"') + '"' if title else "") + ")"
        return body

    def block(self, node: _Node) -> list[str]:
        """Paragraphs of a node's children."""
        out: list[str] = []
        run: list[str] = []

        def close() -> None:
            if not run:
                return
            text = re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[ \t]{2,}(?!\n)", " ", "".join(run))).strip()
            if text:
                out.append(text)
            run.clear()

        for x in node.children:
            tag = x.tag if isinstance(x, _Node) else ""
            if tag in _DROPPED or tag in ("head", "title"):
                continue
            if tag in _HEADINGS:
                close()
                text = " ".join("".join(self.inline(y, True) for y in x.children).split())
                if text:
                    out.append("#" * _HEADINGS[tag] + " " + text)
            elif tag in ("ul", "ol"):
                close()
                out += self.listed(x)
            elif tag == "pre":
                close()
                out.append("```\n" + _text(x).strip("\n") + "\n```")
            elif tag == "blockquote":
                close()
                out.append("\n".join("> " + line for line in "\n\n".join(self.block(x)).split("\n")))
            elif tag == "hr":
                close()
                out.append("---")
            elif tag == "table":
                close()
                out += self.table(x)
            elif tag in _BLOCK or tag in ("html", "body"):
                close()
                if x.children:
                    out += self.block(x)
            elif isinstance(x, _Node) and any(isinstance(y, _Node) and (y.tag in _BLOCK or y.tag in _HEADINGS or y.tag in ("ul", "ol", "table", "pre")) for y in x.children):
                close()
                out += self.block(x)
            else:
                run.append(self.inline(x))
        close()
        return out

    def listed(self, node: _Node) -> list[str]:
        lines, n = [], 0
        for x in node.children:
            if isinstance(x, _Node) and x.tag == "li":
                n += 1
                mark = f"{n}. " if node.tag == "ol" else "* "
                body = "\n".join(self.block(x)).split("\n")
                lines.append(mark + "\n".join([body[0], *(" " * len(mark) + y for y in body[1:])]))
        return ["\n".join(lines)] if lines else []

    def table(self, node: _Node) -> list[str]:
        rows: list[list[str]] = []

        def walk(x: _Node) -> None:
            for y in x.children:
                if isinstance(y, _Node):
                    if y.tag == "tr":
                        rows.append([" ".join("".join(self.inline(z, True) for z in c.children).split()).replace("|", "\\|") for c in y.children if isinstance(c, _Node) and c.tag in ("td", "th")])
                    else:
                        walk(y)

        walk(node)
        rows = [r for r in rows if r]
        if not rows:
            return []
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return ["\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])]


def html_to_markdown(html: str) -> tuple[str | None, str]:
    """(title, Markdown) of a document: its body if it has one; scripts and styles are dropped; no title element: null."""
    tree = _Tree()
    tree.read(html)
    title = _find(tree.root, "title")
    body = _find(tree.root, "body") or tree.root
    text = " ".join(_text(title).split()) if title else None
    return text or None, "\n\n".join(_Writer().block(body))
