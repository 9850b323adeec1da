"""Leaf blocks of a web page with the features that tell article text from the rest."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")

# Elements by what they do to the text around them (fixed values of the HTML language).
_BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select
summary table tbody td tfoot th thead tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template iframe object svg math canvas audio video title head textarea datalist".split())
_RAW = frozenset("script style title textarea iframe".split())
# An opening tag closes these open elements, if nothing of the set behind them stands between.
_CLOSES = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
           "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
           "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
           "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
           "option": (frozenset(["option"]), frozenset(["select"]))}
_P_FENCE = frozenset("td th button table body li".split())


@dataclass
class Block:
    """Text between two block boundaries and where it stands."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # tag and class words of the ancestors, outermost first
    linked: int  # characters inside links


def _words(attributes: str) -> tuple[str, ...]:
    if not attributes or attributes == "/":
        return ()
    out: list[str] = []
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "style":
            out += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else []
        elif name in ("hidden", "aria-hidden"):
            out += ["hidden"] if value != "false" else []
        else:
            out += _NAME.findall(value)
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page in order, character references decoded, white space collapsed."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = silent = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, tuple(stack), linked))
        pieces.clear()
        linked = 0

    def pop_to(index: int) -> None:
        nonlocal silent, links
        for tag, _ in stack[index:]:
            silent -= tag in _SILENT
            links -= tag == "a"
        del stack[index:]

    at, end = 0, len(page)
    while at < end:
        match = _TOKEN.search(page, at)
        text = page[at:match.start() if match else end]
        if text and not silent:
            text = html.unescape(text)
            pieces.append(text)
            linked += len(text) if links else 0
        if not match:
            break
        at = match.end()
        closing, tag, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" or tag == "img":
            pieces.append(" ")
            continue
        breaks = tag in _BLOCKS
        if breaks:
            flush()
        if closing:
            for index in range(len(stack) - 1, -1, -1):
                if stack[index][0] == tag:
                    pop_to(index)
                    break
                if stack[index][0] in ("td", "th", "table") and not breaks:
                    break
            continue
        if tag == "body":
            pop_to(next((i for i, s in enumerate(stack) if s[0] == "head"), len(stack)))
        closes, fence = _CLOSES.get(tag, (frozenset(["p"]), _P_FENCE) if breaks and tag not in ("button", "option") else (frozenset(), frozenset()))
        if closes:
            lowest = None
            for index in range(len(stack) - 1, -1, -1):
                if stack[index][0] in fence and stack[index][0] not in closes:
                    break
                if stack[index][0] in closes:
                    lowest = index
                    if tag != "tr":
                        break
            if lowest is not None:
                pop_to(lowest)
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCKS and tag not in _SILENT:
            continue
        stack.append((tag, _words(attributes)))
        silent += tag in _SILENT
        links += tag == "a"
        if tag in _RAW:  # nothing but its own end tag ends it
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            pop_to(len(stack) - 1)
    flush()
    return out


#: Elements that say nothing about the part of the page they stand in, unless they carry class words.
_PLAIN = frozenset("""a b blockquote body br center dd div dl dt em figcaption figure font h1 h2 h3 h4 h5 h6 html i li ol p pre q s
small span strong table tbody td th thead tr u ul""".split())


def _nearest(path: tuple[tuple[str, tuple[str, ...]], ...]) -> list[str]:
    """The innermost ancestor that says something, and whether any does."""
    for tag, words in reversed(path):
        if tag not in _PLAIN or words:
            return [f"near-{tag}" if tag not in _PLAIN else "near-plain", *(f"near-class-{w}" for w in words)]
    return ["near-nothing"]


def features(parts: list[Block]) -> list[list[str]]:
    """Names of the features that hold, by block."""
    out = []
    for i, part in enumerate(parts):
        tags = {t for t, _ in part.path}
        words = {w for _, ws in part.path for w in ws}
        n, size = len(part.text.split(" ")), len(part.text)
        own = ["bias", f"words{min(n, 64).bit_length()}", f"links{4 * part.linked // size}", f"end{part.text[-1] if part.text[-1] in '.!?:,;' else '-'}"]
        own += [f"in-{t}" for t in tags if t not in ("html", "body")]
        own += [f"class-{w}" for w in words]
        own += _nearest(part.path)
        own += ["nested"] if sum(t == "article" for t, _ in part.path) > 1 else []
        if part.path:
            own.append(f"leaf-{part.path[-1][0]}")
        own += ["mark"] if re.search(r"[©®™]|\b(?:19|20)[0-9]{2}\b", part.text) else []
        own += ["first"] if i == 0 else ["last"] if i == len(parts) - 1 else []
        out.append(own)
    return out
