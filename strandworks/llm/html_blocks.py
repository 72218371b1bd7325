"""Leaf blocks of an HTML page, with the tag path of each."""

from __future__ import annotations

import html
import re
import zlib

#: Elements that end a line of text, elements whose content is never text, and elements without content.
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td textarea tfoot th thead title tr ul video".split()
)
RAW = frozenset("script style noscript template iframe svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)""", re.S
)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECE = re.compile(r"[a-zA-Z]+")

#: Buckets of hashed path items.
PATH_DIM = 256


def bucket(item: str) -> int:
    return zlib.crc32(item.encode()) % PATH_DIM


class Paths:
    """Numbers tag paths; a path is the set of hashed tags and class, id and role words from the root down."""

    def __init__(self) -> None:
        self.items: list[tuple[int, ...]] = [()]
        self._next: dict[tuple[int, str, str], int] = {}

    def step(self, parent: int, tag: str, attributes: str) -> int:
        key = (parent, tag, attributes if "class" in attributes or "id" in attributes or "role" in attributes else "")
        if key not in self._next:
            words = [tag] + [f".{w.lower()}" for m in NAMED.findall(key[2]) for w in PIECE.findall("".join(m))]
            if len(self._next) > 20_000:  # attribute values may be unbounded in number
                self._next.clear()
            self._next[key] = len(self.items)
            self.items.append(tuple(sorted({*self.items[parent], *map(bucket, words)})))
        return self._next[key]


def blocks(page: str, paths: Paths) -> list[tuple[int, str]]:
    """(path, text) of the leaf blocks in page order: decoded, white space turned into single spaces, trimmed, not empty."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    path = at = 0
    first = 0  # the path where the block's text began

    def end() -> None:
        if text:
            whole = "".join(text)
            line = " ".join((html.unescape(whole) if "&" in whole else whole).split())
            if line:
                out.append((first, line))
            text.clear()

    def pop(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return

    pos = 0
    while pos < len(page):
        m = TOKEN.search(page, pos)
        piece = page[pos : m.start()] if m else page[pos:]
        if piece:
            if not text:
                if piece.strip():
                    first = path
                    text.append(piece)
            else:
                text.append(piece)
        if not m:
            break
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            end()
        if m[1]:
            pop(tag)
        elif tag in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = close.end() if close else len(page)
        elif tag not in VOID:
            if tag in BLOCK:
                while stack and stack[-1][0] not in BLOCK:
                    stack.pop()
                if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    stack.pop()
            for other in CLOSES.get(tag, ()):
                if stack and stack[-1][0] == other:
                    stack.pop()
            parent = stack[-1][1] if stack else 0
            stack.append((tag, paths.step(parent, tag, m[3])))
        path = stack[-1][1] if stack else 0
    end()
    return out
