"""Worked examples of the note format: what is given and what has to come out of it."""

from __future__ import annotations

# (kind, given, wanted): kinds are "inline" (a stretch of text), "line" (a whole line, null if it says
# nothing), "host" (an address), "trail" (a note; its passages' headings), "body" (a note; its passages' texts),
# "line no" (a note; the lines its passages begin on), "off" (a note; whether it is kept out).
EXAMPLES: list[tuple[str, str, str | None]] = [
    ("inline", "ask [[Owl | Pine]] today", "ask Owl Pine today"),
    ("inline", "[[Kettle]], [[Shed/Ladder]]", "Kettle, Ladder"),
    ("inline", "[[Kettle|the old one]]", "the old one"),
    ("inline", "[[Kettle\\|in a table]]", "in a table"),
    ("inline", "[[Kettle#Descaling]]", "Kettle > Descaling"),
    ("inline", "[[#Further down]]", "Further down"),
    ("inline", "[[Kettle#^k81]]", "Kettle"),
    ("inline", "[[Kettle#Descaling|how to]]", "how to"),
    ("inline", "left ![[boiler.jpg]] right", "left  right"),
    ("inline", "![[Kettle]] ![[Kettle#Descaling]]", "Kettle Kettle"),
    ("inline", "[plans](https://shed.example/p?q=3) ![sketch](s.webp)", "plans sketch"),
    ("inline", "read https://SHED.example/a/b.html first", "read shed.example first"),
    ("inline", "<https://shed.example/z>", "shed.example"),
    ("inline", "**two** ==three== ~~four~~ `five` six[^7]", "two three four five six"),
    ("inline", '<b class="y">seven</b>', "seven"),
    ("line", "> [!tip] Descale monthly", "Descale monthly"),
    ("line", "> a borrowed sentence", "a borrowed sentence"),
    ("line", "- [x] oil the hinge", "- oil the hinge"),
    ("line", "The hinge squeaks ^hinge7", "The hinge squeaks"),
    ("line", "| :-- | --- | --: |", None),
    ("line", "| rope | 12 m | blue |", "rope; 12 m; blue"),
    ("line", "- - -", None),
    ("line", "***", None),
    ("line", "\t ", None),
    ("line", "an *odd* star and a long_file_name", "an *odd* star and a long_file_name"),
    ("host", "http://möbel.example/liste", "xn--mbel-5qa.example"),
    ("host", "https://Shed.Example:8080/a", "shed.example"),
    ("trail", "# Top\n\nfirst words stand here\n\n## Deep\n\n### Deeper\n\nlast words stand here\n", "Top|Top > Deep > Deeper"),
    ("trail", "## Thin\n\nonly two\n\n## Thick\n\nthese are three words\n", "Thick"),
    ("trail", "plain words without heading\n", ""),
    ("trail", "# A\n\nopening words stand here\n\n```\n# inside is no heading\n```\n\n## B\n\nclosing words stand here\n", "A|A > B"),
    ("body", "# A\n\nseen here %%not this%% and there\n", "seen here and there"),
    ("body", "one two three <!-- not\nthis --> four\n", "one two three\nfour"),
    ("body", "~~~mermaid\ngraph of nothing much\n~~~\n\nonly these words remain\n", "only these words remain"),
    ("line no", "﻿# One\r\n\r\nwords of the first\r\n\r\n## Two\r\n\r\nwords of the second\r\n", "3|7"),
    ("off", "---\nindex: off\n---\nnever to be seen words\n", "true"),
    ("off", "---\nINDEX: 'No'\n---\nnever to be seen words\n", "true"),
    ("off", "---\nindex: 0\n---\nnever to be seen words\n", "true"),
    ("off", "---\n  index: false\n---\nto be seen words\n", "false"),
    ("off", "---\nindex: falsehood\n---\nto be seen words\n", "false"),
    ("off", "---\nindex: true\n---\nto be seen words\n", "false"),
]


def answer(kind: str, given: str) -> str | None:
    """What the chunker makes of an example."""
    from notefold.chunker.chunk import chunk
    from notefold.chunker.markdown import clean_inline, clean_line, host

    if kind == "inline":
        return clean_inline(given)
    if kind == "line":
        return clean_line(given)
    if kind == "host":
        return host(given)
    note = chunk(given.encode("utf-8"), "Box/Some note.md")
    if kind == "off":
        return str(not note.indexable).lower()
    show = {"trail": lambda p: " > ".join(p.trail), "body": lambda p: p.text, "line no": lambda p: str(p.line)}[kind]
    return "|".join(map(show, note.passages))
