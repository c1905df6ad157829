"""Prose of LaTeX texts by block.

Blocks are the pieces of a text between blank lines (lines of spaces or tabs are blank), counted from 1. Prose is what
whole sentences are made of, captions included, without comments, formulas, headings, preamble and bibliography. Every
step works on the whole text at once with the block boundaries marked, so a comment or environment may span blocks.

Defined results: a null or empty text has no blocks. CR LF and CR count as LF. A text without ``\\begin{document}`` is
body from its start. An environment that never ends is left as it is, but a bibliography lasts to the end.
"""

from __future__ import annotations

import re
import unicodedata

MARK = "\x00"
_BLANK = re.compile(r"\n(?:[ \t]*\n)+")
_LEAD = re.compile(r"\A(?:[ \t]*\n)+")
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_IFFALSE = re.compile(r"\\iffalse(?![A-Za-z]).*?(?:\\fi(?![A-Za-z])|\Z)", re.S)
_BIB = re.compile(r"\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)", re.S)
_MATHENV = re.compile(
    r"\\begin\{((?:equation|align|alignat|flalign|gather|multline|eqnarray|displaymath|math|dmath|array|tabular|tabularx|longtable"
    r"|verbatim|lstlisting|minted|tikzpicture|algorithm|algorithmic|filecontents|comment)\*?)\}.*?\\end\{\1\}",
    re.S,
)
_DISPLAY = re.compile(r"\\\[.*?\\\]|\$\$.*?\$\$", re.S)
_INLINE = re.compile(r"(?<!\\)\$[^$\x00]*\$|\\\([^\x00]*?\\\)")
_ARG = r"\{(?:[^{}\x00]|\{(?:[^{}\x00]|\{(?:[^{}\x00]|\{[^{}\x00]*\})*\})*\})*\}"
_DROPPED = re.compile(
    r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title|subtitle|author|date|thanks|affil|label|(?:eq|page|auto|c|C)?ref"
    r"|[Cc]ite[a-zA-Z]*|nocite|input|include|subfile|includegraphics|bibliography|bibliographystyle|addbibresource|usepackage"
    r"|documentclass|selectlanguage|url|vspace|hspace|newcommand|renewcommand|providecommand|DeclareMathOperator|def|setlength"
    r"|pagestyle|thispagestyle|keywords|pacs|bibitem|footnotemark|graphicspath|foreignlanguage)\*?(?![A-Za-z])\s*(?:\[[^\]\x00]*\]\s*)*"
    rf"(?:\\[A-Za-z]+)?(?:{_ARG})*"
)
_PHRASE = re.compile(rf"\\(?:emph|textit)\s*\{{\s*\((?:[^{{}}\x00]|{_ARG})*\}}")
_ENVMARK = re.compile(rf"\\begin\{{otherlanguage\*?\}}(?:\[[^\]\x00]*\])?{_ARG}|\\(?:begin|end)\{{[^}}\x00]*\}}(?:\[[^\]\x00]*\])?")
_ACCENT = re.compile(r"""\{?\\(?:(['"`^~=.])\s*(?:\{\s*(\\?[A-Za-z])\s*\}|(\\[ij](?![A-Za-z])|[A-Za-z])|\{(\\[ij])\s*\})|([cvHukrdb])\s*(?:\{\s*([A-Za-z])\s*\}|\s([A-Za-z])))\}?""")
_SPECIAL = re.compile(r"\{?\\(ss|oe|OE|ae|AE|aa|AA|o|O|l|L|i|j)(?![A-Za-z])(?:\{\})?\s?\}?")
_COMMAND = re.compile(r"\\[A-Za-z@]+\*?|\\.|[{}~\[\]]")
_COMBINING = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "H": "\u030b", "u": "\u0306", "k": "\u0328", "r": "\u030a", "d": "\u0323", "b": "\u0331"}
_LETTERS = {"ss": "ß", "oe": "œ", "OE": "Œ", "ae": "æ", "AE": "Æ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "i", "j": "j"}


def _marks(m: re.Match) -> str:
    return " " + MARK * m.group().count(MARK)


class Accents(dict):
    """Letter of an accent's markup, by the markup as it stands."""

    def __missing__(self, text: str) -> str:
        m = _ACCENT.fullmatch(text)
        accent = m[1] or m[5]
        letter = (m[2] or m[3] or m[4] or m[6] or m[7]).lstrip("\\")
        out = unicodedata.normalize("NFC", letter + _COMBINING[accent])
        # an opening brace without its closing one, or the other way round, stays
        out = ("{" if text[0] == "{" and text[-1] != "}" else "") + out
        if len(self) < 4096:
            self[text] = out
        return out


def blocks(text: str | None, accents: dict[str, str]) -> list[str]:
    """Prose of each block, '' where a block has none. ``accents`` is an ``Accents`` kept by the caller."""
    if not text:
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if MARK in text:
        text = text.replace(MARK, " ")
    text = _BLANK.sub("\n" + MARK, _LEAD.sub("", text)).removesuffix(MARK)
    if "%" in text:
        text = _COMMENT.sub("", text)
    if "\\iffalse" in text:
        text = _IFFALSE.sub(_marks, text)
    at = text.find("\\begin{document}")
    if at >= 0:
        text = MARK * text.count(MARK, 0, at) + text[at + 16 :]
    at = text.find("\\end{document}")
    if at >= 0:
        text = text[:at] + MARK * text.count(MARK, at)
    if "thebibliography" in text:
        text = _BIB.sub(_marks, text)
    if "\\" in text or "$" in text:
        text = _MATHENV.sub(_marks, text)
        text = _DISPLAY.sub(_marks, text)
        text = _INLINE.sub(" ", text)
        text = _DROPPED.sub(" ", text)
        text = _PHRASE.sub(" ", text)
        text = _ENVMARK.sub(" ", text)
        text = _ACCENT.sub(lambda m: accents[m.group()], text)
        text = _SPECIAL.sub(lambda m: _LETTERS[m[1]], text)
        text = _COMMAND.sub(" ", text)
    return [" ".join(b.split()) for b in text.split(MARK)]
