"""Plain wording of wiki texts. Every function takes time in proportion to the text."""

from __future__ import annotations

import html
import re

_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_OUTER = re.compile(r"\[(?:https?:)?//[^\s\]]*\s*([^\]]*)\]")
_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile(r"'{2,}")
_EDGE = re.compile(r"\{\{|\}\}|\{\||\|\}")


def _without(text: str, start: str, end: str) -> str:
    """Text without what lies between the two marks; a mark that is never closed stays."""
    out, at = [], 0
    while (a := text.find(start, at)) >= 0 and (b := text.find(end, a + len(start))) >= 0:
        out += [text[at:a], " "]
        at = b + len(end)
    return "".join([*out, text[at:]])


def _without_refs(text: str) -> str:
    out, at = [], 0
    while (a := text.find("<ref", at)) >= 0 and (b := text.find(">", a)) >= 0:
        out += [text[at:a], " "]
        at = b + 1
        if text[b - 1] != "/":
            c = text.find("</ref>", at)
            if c >= 0:
                at = c + 6
    return "".join([*out, text[at:]])


def _without_nested(text: str, tables: bool) -> str:
    """Text without templates and, if asked, tables; unclosed ones stay."""
    closed: list[tuple[int, int]] = []
    open_: list[tuple[str, int]] = []
    for m in _EDGE.finditer(text):
        t = m.group()
        if t in ("{{", "{|"):
            open_.append((t, m.start()))
        else:
            want = "{{" if t == "}}" else "{|"
            if open_ and open_[-1][0] == want:
                kind, a = open_.pop()
                if kind == "{{" or tables:
                    while closed and closed[-1][0] >= a:
                        closed.pop()
                    closed.append((a, m.end()))
    out, at = [], 0
    for a, b in closed:
        out += [text[at:a], " "]
        at = b
    return "".join([*out, text[at:]])


def _label(m: re.Match) -> str:
    inner = m.group(1)
    head = inner.split(":", 1)[0].strip().lower() if ":" in inner else ""
    if head in ("file", "image", "datei", "fichier", "archivo", "category", "kategorie", "catégorie", "categoría"):
        return " "
    return inner.rsplit("|", 1)[-1]


def plain(text: str | None, tables: bool = False) -> str:
    """Text without comments, references, templates, tags and link targets; ``tables`` drops tables too. Null gives an empty string."""
    if not text:
        return ""
    t = text
    if "<" in t:
        t = _without_refs(_without(t, "<!--", "-->"))
    if "{" in t:
        t = _without_nested(t, tables)
    if "[" in t:
        t = _OUTER.sub(r"\1", _LINK.sub(_label, _LINK.sub(_label, t)))
    if "<" in t:
        t = _TAG.sub(" ", t)
    return _QUOTES.sub("", html.unescape(t))


def wording(text: str | None) -> list[str]:
    """Words in lower case, without markup, punctuation and apostrophes."""
    return _WORD.findall(plain(text).lower().replace("'", "").replace("’", ""))


_INSERT = re.compile(r"<!--|-->|<ref\b[^<>]*>|</ref\s*>|\{\{|\}\}|\[\[|\]\]", re.IGNORECASE)
_PICTURE = re.compile(r"\[\[\s*(?:file|image|datei|bild|fichier|archivo)\s*:", re.IGNORECASE)
_SIGN = re.compile(r"<!--|-->|</?[a-zA-Z][^<>]*>")


def _inserts(text: str) -> list[str]:
    """What lies in references, templates, comments and pictures, each without those inside of it; unclosed ones are none."""
    open_: list[tuple[str, int, bool]] = []
    count = {"<!--": 0, "<ref": 0, "{{": 0, "[[": 0}
    spans = []
    for m in _INSERT.finditer(text):
        t = m.group()
        kind = {"-->": "<!--", "}}": "{{", "]]": "[["}.get(t, "<ref" if t[:2] == "</" else None)
        if kind is None:
            kind = t if t in count else "<ref"
            if not t.endswith("/>"):
                open_.append((kind, m.start(), kind != "[[" or bool(_PICTURE.match(text, m.start()))))
                count[kind] += 1
        elif count[kind]:
            while True:
                was, a, own = open_.pop()
                count[was] -= 1
                if was == kind:
                    break
            if own:
                spans.append((a, m.end()))
    out, held, at = [], [], 0
    spans.sort()
    for a, b in [*spans, (len(text), len(text))]:
        while held and held[-1][0] <= a:
            end, parts = held.pop()
            out.append("".join([*parts, text[at:end]]))
            at = end
        if held:
            held[-1][1].extend((text[at:a], " "))
        held.append((b, []))
        at = a
    return out


def _inner(m: re.Match) -> str:
    inner = m.group(1)
    return inner if _label(m) == " " else inner.rsplit("|", 1)[-1]


def _unmarked(text: str) -> list[str]:
    """Words of a text without the signs of markup only: tags, braces, brackets and link targets."""
    t = _SIGN.sub(" ", text) if "<" in text or "-->" in text else text
    if "[" in t:
        t = _OUTER.sub(r"\1", _LINK.sub(_inner, _LINK.sub(_inner, t)))
    return _WORD.findall(html.unescape(t).lower().replace("'", "").replace("’", ""))


def streams(text: str | None) -> list[list[str]]:
    """The runs of words in which a passage may lie: the wording; what each reference, template, comment or picture says; and the whole text, of
    which only the signs of markup are left out. A run that would only repeat the wording is left out."""
    out = [wording(text)]
    if text and ("<" in text or "{" in text or "[" in text):
        whole = _unmarked(text)
        if whole != out[0]:
            out += [*map(_unmarked, _inserts(text)), whole]
    return out


_END = re.compile(r"(?<=[.!?])[\"”»)\]]?\s+(?=[\"“«(¿¡]?[A-ZÀ-ÖØ-Þ])")
_NOT_PROSE = "=*#|!{}:;<"


def sentences(text: str | None) -> list[str]:
    """Prose sentences: without headings, lists, tables, indented and template lines, redirects and fragments without two words."""
    if not text or text.lstrip()[:9].lower() == "#redirect":
        return []
    out = []
    for line in plain(text, tables=True).split("\n"):
        line = line.strip()
        if line and line[0] not in _NOT_PROSE:
            out += [s for s in _END.split(line) if len(_WORD.findall(s)) >= 3]
    return out


def tokens(sentence: str) -> list[str]:
    """Words in lower case; numbers are one token."""
    return ["9" if w.isdigit() else w for w in _WORD.findall(sentence.lower())]
