"""Blocks of text, slots and zones of a page, read off its tags."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import xxhash

# The next tag, comment or declaration. Quoted values may hold ">", but no "<", so that a stray quote ends at the next tag.
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^<>"']|"[^<"]*"|'[^<']*')*+)>|(?P<loose>[^<>]*)(?:>|(?=<)|\Z))|[!?][^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

# Elements and names by their meaning in HTML and by custom of page authors.
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg math xmp".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param keygen".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote caption figcaption legend summary address td th tr option".split())
NEVER = frozenset("aside footer menu dialog button select datalist object canvas audio video".split())  # no main text, wherever they are
AROUND = frozenset("nav header form search head".split())  # none either, but for an article inside
OUTSIDE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead toolbar topbar ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended "
    "comment comments disqus reply replies respond pagination pager skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl menu table tbody thead tfoot select body html article main section div td th".split())


class Block(NamedTuple):
    text: str
    slot: int  # hash of the path of elements that hold it
    token: int  # hash of slot and text
    main: int  # 2 in an article, 1 in the main part, 0 elsewhere
    box: tuple  # hashes of the paths of the enclosing elements that may hold many blocks
    links: int  # characters of the text that lie in links
    place: int  # number of the token on the page


class Page(NamedTuple):
    opened: list  # (path hash, place) of every start tag
    blocks: list  # Block for all text outside the zones that are no main text


def _hash(above: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label, above & 0xFFFFFFFFFFFFFFFF) >> 1


def _attrs(text: str) -> dict:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(text)} if "=" in text else {}


def _says_outside(attrs: dict) -> bool:
    """Whether class, id or role name something that is no main text: by the last word of each name ("post-comments"), unless it says with or without."""
    if attrs.get("role", "").lower() in ROLES:
        return True
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[0] not in ("has", "no", "with", "without", "show", "hide", "is") and (words[-1] in OUTSIDE or words[0] in OUTSIDE and len(words) > 1 and words[-1] in ("box", "bar", "wrapper", "wrap", "container", "list", "block", "area", "section", "widget", "form", "slot", "unit", "links")):
            return True
    return False


class _Open(NamedTuple):
    name: str
    path: int
    out: int  # 2 never main text, 1 only in an article inside, 0 may be
    main: int
    link: bool
    box: tuple


def read(page: str | None) -> Page:
    """The start tags and blocks of a page.

    Blocks are cut at the start and end of block elements; white space is one blank, references are decoded. End tags that
    are left out are supplied where the next tag implies them, and those that close nothing are passed over.
    """
    source = page or ""
    stack = [_Open("", 0, 0, 0, False, ())]
    opened: list = []
    blocks: list = []
    text: list[str] = []
    linked = place = at = 0

    def flush() -> None:
        nonlocal linked, text, place
        if text:
            words = " ".join("".join(text).split())
            if words:
                top = next(e for e in reversed(stack) if e.name in BLOCK or not e.name)
                blocks.append(Block(words, top.path, _hash(top.path, words), top.main, top.box, linked, place))
                place += 1
        text, linked = [], 0

    while True:
        tag = _TAG.search(source, at)
        end = tag.start() if tag else len(source)
        top = stack[-1]
        if end > at and not top.out:
            run = source[at:end]
            text.append(html.unescape(run) if "&" in run else run)
            if top.link:
                linked += len(run)
        if not tag:
            break
        at = tag.end()
        name = tag["name"]
        if not name:
            continue
        name = name.lower()
        if tag["end"]:
            block = name in BLOCK
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    if block:
                        flush()
                    del stack[k:]
                    break
                if not block and stack[k].name in BLOCK:
                    break
            continue
        if name in RAW:
            skip = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = skip.end() if skip else len(source)
            continue
        if name == "br" or name in VOID and name != "hr":
            if not top.out:
                text.append(" ")
            continue
        if name in BLOCK:
            flush()
            gone = CLOSES.get(name, set()) | {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in gone:
                    del stack[k:]
                    if name not in CLOSES:
                        break
                elif stack[k].name in HOLDS:
                    break
            if name == "hr":
                continue
        top = stack[-1]
        written = tag["attrs"] if tag["attrs"] is not None else tag["loose"]
        attrs = _attrs(written)
        kind = re.sub(r"\d+", "", attrs.get("class", "") or attrs.get("id", "")) if attrs else ""
        path = _hash(top.path, f"{name} {kind}")
        named = name not in ("html", "body", "main", "a") and _says_outside(attrs)
        main, out = top.main, top.out
        if name in ("article", "main") or attrs.get("role", "").lower() == "main" or attrs.get("itemprop") == "articleBody":
            level = 1 if name == "main" or attrs.get("role", "").lower() == "main" else 2
            if out == 1 and not named:
                out = 0
            main = max(main, level)
        if name in NEVER:
            out = 2
        elif named:
            out = 2 if main else max(out, 1)
        elif name in AROUND and not (name == "header" and main == 2):
            out = max(out, 1)
        box = top.box if name in LEAF or name not in BLOCK else (*top.box, path)
        opened.append((path, place))
        place += 1
        stack.append(_Open(name, path, out, main, top.link or name == "a", box))
    flush()
    return Page(opened, blocks)
