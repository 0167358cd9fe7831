"""Text functions that no built-in expression covers, vectorised over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators from coarse to fine, sizes in characters, the brackets of leaked commentary, its keyword, and the reach in which that must stand.
SEPARATORS = ("\n\n", "\n", ". ", " ")
CHUNK_SIZE, OVERLAP = 3200, 400
OPEN, CLOSE, KEYWORD, REACH = "【", "】", "commentary", 32

Span = tuple[int, int]


def _runs(text: str, span: Span, separator: str, size: int) -> Iterator[Span]:
    """The span as runs of the parts between separators, each as long as fits; a part that is too long is a run of its own."""
    at, end = span
    run = (at, at)
    while at <= end:
        cut = text.find(separator, at, end)
        part = (at, cut if cut >= 0 else end)
        if run[0] < run[1] and part[1] - run[0] <= size:
            run = (run[0], part[1])
        else:
            if run[0] < run[1]:
                yield run
            run = part
        if cut < 0:
            break
        at = cut + len(separator)
    if run[0] < run[1]:
        yield run


def split_spans(text: str, size: int = CHUNK_SIZE) -> list[Span]:
    """Where the pieces of a text are, each of at most ``size`` code points and not blank.

    One pass over the spans for each separator: what fits stays, what does not is cut there. Separators at the cuts belong to no piece.
    """
    spans = [(0, len(text))]
    for separator in SEPARATORS:
        spans = [s for span in spans for s in ([span] if span[1] - span[0] <= size else _runs(text, span, separator, size))]
    hard = [(i, min(i + size, b)) for a, b in spans for i in range(a, b, size)]
    return [(a, b) for a, b in hard if text[a:b].strip()]


def split_pieces(text: str, size: int = CHUNK_SIZE) -> list[str]:
    return [text[a:b] for a, b in split_spans(text, size)]


def chunks(text: str | None, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces, each but the first after the end of the piece before it."""
    text = text or ""
    spans = split_spans(text, size)
    return [text[max(p, q - overlap) : q] + text[a:b] for (p, q), (a, b) in zip([(0, 0), *spans], spans)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_text(texts: pd.Series) -> pd.Series:
    return texts.map(chunks)


@dataclass
class CommentaryFilter:
    """Takes leaked commentary out of a text that comes in pieces: brackets that open on the keyword, with all brackets nested in them.

    Outside commentary text comes out at once, but for blanks at its end and for a bracket whose keyword may
    still come; inside nothing is kept, so the state is a few characters whatever the length of the text.
    Blanks after commentary go if there are blanks before it; if any was taken out, blanks at the end of the
    text go, and at its start those that had not come out yet. Commentary that is never closed takes the rest.
    """

    depth: int = 0  # open brackets of the commentary that is being skipped
    held: str = ""  # blanks that are kept but have not come out
    undecided: str = ""  # a bracket whose keyword may still come, with what follows it
    after_blank: bool = False  # the last character that came out was a blank
    skips_blanks: bool = False  # commentary after a blank has just ended
    removed: bool = False
    started: bool = False  # something that is no blank has come out

    @staticmethod
    def _opens(text: str) -> bool | None:
        """Whether a text that starts with an opening bracket opens commentary; None if what follows must tell."""
        inner = text[1:REACH]
        word = inner.lstrip()
        if word[: len(KEYWORD)].lower() == KEYWORD:
            return True
        return None if len(text) < REACH and KEYWORD.startswith(word.lower()) else False

    def push(self, piece: str) -> str:
        return self._scan(self.undecided + piece, False)

    def flush(self) -> str:
        """The rest at the end of the text."""
        return self._scan(self.undecided, True)

    def _scan(self, text: str, is_end: bool) -> str:
        kept = [self.held] if self.held else []
        at, end = 0, len(text)
        while at < end:
            if self.depth:
                m = _BRACKET.search(text, at)
                if not m:
                    break
                at = m.end()
                self.depth += 1 if m[0] == OPEN else -1
                self.skips_blanks = not self.depth and self._ends_blank(kept)
            elif self.skips_blanks and text[at] in " \t":
                at += 1
            else:
                self.skips_blanks = False
                start = text.find(OPEN, at)
                if start != at:
                    kept.append(text[at : start if start >= 0 else end])
                    at = start if start >= 0 else end
                elif (opens := self._opens(text[at : at + REACH])) is None and not is_end:
                    break
                elif opens:
                    self.depth, self.removed, at = 1, True, at + 1
                else:
                    kept.append(OPEN)
                    at += 1
        self.undecided = "" if self.depth else text[at:]
        return self._let_out("".join(kept), is_end)

    def _ends_blank(self, kept: list[str]) -> bool:
        return kept[-1][-1] in " \t" if kept else self.after_blank

    def _let_out(self, kept: str, is_end: bool) -> str:
        out = kept if is_end and not self.removed else kept.rstrip()
        self.held = "" if is_end else kept[len(out) :]
        if self.removed and not self.started:
            out = out.lstrip()
        self.started |= bool(out.strip())
        if out:
            self.after_blank = out[-1] in " \t"
        return out


_BRACKET = re.compile(f"[{OPEN}{CLOSE}]")


def strip_commentary(text: str) -> str:
    """Without leaked commentary; a text that has none stays as it is."""
    f = CommentaryFilter()
    return f.push(text) + f.flush()


@F.pandas_udf(T.StringType())
def without_commentary(texts: pd.Series) -> pd.Series:
    return texts.map(strip_commentary, na_action="ignore")


def sse_frames(buffer: str) -> tuple[list[str], str]:
    """The data of all complete frames of a server-sent stream, and what is left over."""
    *whole, rest = buffer.replace("\r\n", "\n").split("\n\n")
    frames = ["\n".join(line[5:].removeprefix(" ") for line in f.split("\n") if line.startswith("data:")) for f in whole]
    return [f for f in frames if f], rest


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 units."""
    h = 0x811C9DC5
    units = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (h ^ (units[i] | units[i + 1] << 8)) * 0x01000193 & 0xFFFFFFFF
    return h


def seeded_order(seed_text: str, labels: list[str]) -> list[str]:
    """A reproducible shuffle: Fisher-Yates driven by the mulberry32 generator, seeded from a text."""
    state, order = fnv1a(seed_text), list(labels)
    for i in range(len(order) - 1, 0, -1):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = (state ^ state >> 15) * (1 | state) & 0xFFFFFFFF
        t = ((t + ((t ^ t >> 7) * (61 | t) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
        j = int((t ^ t >> 14) / 4294967296 * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order
