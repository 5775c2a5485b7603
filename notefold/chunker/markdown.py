"""Reading a note's lines: properties, fences, headings, comments, and Markdown to plain words."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import takewhile
from urllib.parse import urlsplit

from notefold.chunker.chars import collapse, js, trim, trim_end

# The forms of the note format.
_OFF = js(r"""^index\s*:\s*["']?(false|no|off|0)["']?\s*$""", 2)
_KEY = js(r"^[A-Za-z_][\w .\-/]{0,40}:(\s.*)?$")
_ITEM = js(r"^\s*-(\s|$)")
_DEEPER = js(r"^\s+\S")
_NOTE = js(r"^\s*#")
_LISTED = js(r"^(aliases|alias|tags|tag)\s*:(.*)$", 2)
_FENCE = js(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = js(r"^ {0,3}(#{1,6})[ \t]+(.*?)\s*$")
_HEADING_END = js(r"\s+#+\s*$")
_QUOTE = js(r"^\s*(?:>\s?)+")
_CALLOUT = js(r"^\[![^\]]+\][+-]?\s*")
_RULE = js(r"^\s*([-*_])(\s*\1){2,}\s*$")
_TABLE_RULE = js(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_TASK = js(r"^(\s*(?:[-*+]|\d+[.)])\s)\[[ xX]\]\s")
_BLOCK_ID = js(r"\s\^[A-Za-z0-9-]+\s*$")
_TABLE_ROW = js(r"^\s*\|")
_EMBED = js(r"!\[\[([^\]]*)\]\]")
_WIKI = js(r"\[\[([^\]]*)\]\]")
_LINK = js(r'!?\[([^\]]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+"[^"]*")?\)')
_AUTOLINK = js(r"<(https?://[^>\s]+)>")
_URL = js(r"\bhttps?://[^\s<>)\]]+")
_TAG = js(r"</?[a-zA-Z][a-zA-Z0-9-]*(\s[^<>]*)?/?>")
_FOOTNOTE = js(r"\[\^[^\]\s]+\]")
_STYLE = js(r"\*\*|==|~~|`")
_SUFFIX = js(r"\.[A-Za-z0-9]{1,5}$")
_MD = js(r"\.md$", 2)
COMMENTS = (("%%", "%%"), ("<!--", "-->"))


@dataclass
class Properties:
    body: int = 0  # the first line after the block
    index_off: bool = False
    aliases: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)


def _plain(raw: str) -> str:
    """A value without quotes; of a link its shown name."""
    s = trim(raw)
    if s[:1] in ("'", '"') and s[:1] == s[-1:]:
        s = s[1:-1]
    if s.startswith("[[") and s.endswith("]]") and "]" not in s[2:-2]:
        s = s[2:-2].rpartition("|")[2]
    return trim(s)


def _values(value: str) -> list[str]:
    v = trim(value)
    listed = v[:1] == "[" and v[-1:] == "]" and v[:2] != "[["
    return [x for x in map(_plain, v[1:-1].split(",") if listed else [v]) if x]


def read_properties(lines: list[str]) -> Properties:
    """The block between a first line ``---`` and the next; an unfinished one is none.

    ``index: false`` counts in any such block, even one that isn't a list of properties.
    """
    if not lines or trim_end(lines[0]) != "---":
        return Properties()
    end = next((i for i, x in enumerate(lines[1:], 1) if trim_end(x) == "---"), None)
    if end is None:
        return Properties()
    block = lines[1:end]
    off = any(_OFF.search(trim_end(x)) for x in block)
    forms = (_KEY, _ITEM, _DEEPER, _NOTE)
    if not all(trim(x) in ("", "...") or any(f.search(x) for f in forms) for x in block):
        return Properties(index_off=off)
    found = Properties(end + 1, off)
    for i, x in enumerate(block):
        if m := _LISTED.search(x):
            into = found.aliases if m[1].lower().startswith("alias") else found.tags
            below = takewhile(_ITEM.search, block[i + 1 :])
            into += _values(m[2]) + [v for v in (_plain(trim(b)[1:]) for b in below) if v]
    return found


@dataclass(frozen=True)
class Line:
    text: str
    number: int  # from 1, in the file
    code: bool = False


@dataclass
class Section:
    heads: list[str]
    lines: list[Line] = field(default_factory=list)


def _fences(lines: list[str], start: int) -> tuple[dict[int, int], dict[int, str], int | None]:
    """Fenced blocks as {first: last line}, their languages, and the first line below a repaired one.

    A fence ends at a line of at least as many of its marks and nothing else; if there is none, at
    the first later line that begins so; if there is none either, it opens nothing.
    """
    marks = [(i, m[1], m[2]) for i in range(start, len(lines)) if (m := _MARKS.search(lines[i]))]
    spans, languages, repaired = {}, {}, None
    after = start
    for k, (i, _, _) in enumerate(marks):
        m = _FENCE.search(lines[i]) if i >= after else None
        if not m or (m[1][0] == "`" and "`" in m[2]):
            continue
        enders = [(j, rest) for j, run, rest in marks[k + 1 :] if run[0] == m[1][0] and len(run) >= len(m[1])]
        clean = next((j for j, rest in enders if not trim(rest)), None)
        last = clean if clean is not None else enders[0][0] if enders else None
        if last is None:
            continue
        if clean is None:
            repaired = min(x for x in (repaired, last + 1) if x is not None)
        spans[i] = last
        languages[i] = _LANGUAGE_END.split(trim(m[2]))[0].lower()
        after = last + 1
    return spans, languages, repaired


_MARKS = js(r"^ {0,3}(`+|~+)(.*)$")
_LANGUAGE_END = js(r"[\s{,]+")


def sections_of(lines: list[str], start: int, drop: tuple[str, ...]) -> tuple[list[Section], int | None]:
    """The sections in order, each with the chain of headings above it, and the line from which text was repaired."""
    spans, languages, repaired = _fences(lines, start)
    out, chain = [Section([])], []
    i = start
    while i < len(lines):
        if i in spans:
            if languages[i] not in drop:
                out[-1].lines += [Line(lines[j], j + 1, True) for j in range(i + 1, spans[i])]
            i = spans[i] + 1
            continue
        if m := _HEADING.search(lines[i]):
            level = len(m[1])
            chain = [h for h in chain if h[0] < level] + [(level, trim(_HEADING_END.sub("", m[2])))]
            out.append(Section([h for _, h in chain]))
        else:
            out[-1].lines.append(Line(lines[i], i + 1))
        i += 1
    return out, repaired


def _marker_places(lines: list[Line], markers: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """Where comment markers stand outside code and inline code: (line, column, marker)."""
    out = []
    for i, line in enumerate(lines):
        if line.code:
            continue
        quoted, c = False, 0
        while c < len(line.text):
            hit = None if quoted else next((m for m in markers if line.text.startswith(m, c)), None)
            if line.text[c] == "`":
                quoted = not quoted
            if hit:
                out.append((i, c, hit))
            c += len(hit) if hit else 1
    return out


def without_comments(lines: list[Line]) -> list[Line]:
    """Balanced comments taken out; a marker without a partner stays. Lines keep their numbers."""
    for opening, closing in COMMENTS:
        places, pairs, opened = _marker_places(lines, (opening,) if opening == closing else (opening, closing)), [], None
        for p in places:
            if opened is None:
                opened = p if p[2] == opening else None
            elif p[2] == closing:
                pairs.append((opened, p))
                opened = None
        for (i, a, _), (j, b, _) in reversed(pairs):
            lines = list(lines)
            tail = lines[j].text[b + len(closing) :]
            if i == j:
                lines[i] = replace(lines[i], text=lines[i].text[:a] + tail)
            else:
                lines[i] = replace(lines[i], text=lines[i].text[:a])
                lines[i + 1 : j] = [replace(x, text="", code=False) for x in lines[i + 1 : j]]
                lines[j] = replace(lines[j], text=tail)
    return lines


def host(url: str) -> str:
    """The host name of a URL, in lower case and ASCII; empty where there is none."""
    try:
        name = urlsplit(url).hostname or ""
        return name if name.isascii() else name.encode("idna").decode()
    except (ValueError, UnicodeError):
        return ""


def _embedded(inner: str) -> str:
    name = trim(inner.replace(r"\|", "|").split("|")[0].split("#")[0].rpartition("/")[2])
    if _SUFFIX.search(name) and not _MD.search(name):
        return ""  # a picture or another file
    return _MD.sub("", name)


def _linked(inner: str) -> str:
    s = inner.replace(r"\|", "|")
    left, spaced, right = s.partition(" | ")
    if spaced:  # a file's name may hold it
        return f"{trim(left)} {trim(right)}"
    _, piped, shown = s.partition("|")
    if piped:
        return trim(shown)
    target, *parts = s.split("#")
    name = trim(target.rpartition("/")[2])
    places = " > ".join(trim(p) for p in parts if p and not p.startswith("^"))
    return " > ".join(x for x in (name, places) if x)


def clean_inline(s: str) -> str:
    """Inline Markdown as a reader sees it."""
    s = _EMBED.sub(lambda m: _embedded(m[1]), s)
    s = _WIKI.sub(lambda m: _linked(m[1]), s)
    s = _LINK.sub(lambda m: m[1], s)
    s = _AUTOLINK.sub(lambda m: host(m[1]), s)
    s = _URL.sub(lambda m: host(m[0]), s)
    for form in (_TAG, _FOOTNOTE, _STYLE):
        s = form.sub("", s)
    return s


def clean_line(raw: str) -> str | None:
    """A line as a reader sees it; None for rules, table rules and blank lines."""
    s = _CALLOUT.sub("", _QUOTE.sub("", raw, count=1), count=1)
    if _RULE.search(s) or ("|" in s and _TABLE_RULE.search(s)):
        return None
    s = clean_inline(_BLOCK_ID.sub("", _TASK.sub(lambda m: m[1], s, count=1)))
    if _TABLE_ROW.search(s):
        s = "; ".join(c for c in map(trim, s.split("|")) if c)
    return trim(_BLANKS.sub(" ", s)) or None


_BLANKS = js(r"[ \t]+")


def clean_heading(h: str) -> str:
    return collapse(clean_inline(h))
