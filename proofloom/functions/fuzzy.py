"""Approximate matching of one quotation against one passage.

These helpers run inside Spark tasks on pairs that a join has already
selected. Similarity is the ratio of the standard library's sequence matcher;
bit-parallel longest-common-subsequence lengths bound that ratio from above and
skip most windows without changing the outcome.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache
from heapq import heappop, heappush
from math import ceil

# Thresholds of the matching strategies.
FUZZY_MIN = 0.8
MIN_WINDOW = 20
MIN_PHRASE = 10
PHRASE_PAD = 20
MIN_BLOCK = 30
BLOCK_CONFIDENCE_CAP = 0.9
OVERLAP_SHARE = 0.5
MIN_OVERLAP_WORDS = 3
# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = frozenset([
    "al", "et", "eg", "ie", "vs", "fig", "figs", "no", "nos", "cf", "etc",
    "dr", "mr", "mrs", "ms", "st", "jr", "sr", "vol", "pp", "p", "ca",
    "approx", "ref", "refs", "ed", "eds", "i.e", "e.g"])

_SPACE = re.compile(r"\s+")
_WORD4 = re.compile(r"\b\w{4,}\b")
_STOP = re.compile(r"[.!?](?=\s|$)")


def normalize(text: str) -> str:
    return _SPACE.sub(" ", text or "").strip().lower()


class Bound:
    """Upper bound of the ratio between a fixed text and many windows."""

    def __init__(self, text: str):
        self.size = len(text)
        self.full = (1 << self.size) - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | (1 << i)

    def common(self, window: str) -> int:
        row, get, full = self.full, self.masks.get, self.full
        for c in window:
            # A character that the text lacks changes nothing.
            if mask := get(c):
                hit = row & mask
                row = ((row + hit) | (row - hit)) & full
        return self.size - row.bit_count()

    def ratio(self, window: str) -> float:
        return 2.0 * self.common(window) / ((self.size + len(window)) or 1)


def similarity(quote: str, found: str) -> float:
    """1 when the quote is contained, else the matcher's ratio."""
    a, b = normalize(quote), normalize(found)
    if not a or not b:
        return 0.0
    return 1.0 if a in b else SequenceMatcher(None, a, b).ratio()


def shared_grams_needed(n: int, threshold: float, gram: int = 6) -> int:
    """Character grams of a text of n characters that must occur in any text
    whose ratio to it reaches the threshold.

    With M matched characters in B blocks, at least M - (gram - 1) * B grams lie
    inside blocks; the threshold bounds M from below and B from above.
    """
    longest = n * (2 - threshold) / threshold
    blocks = (1 - threshold) * (n + longest) + 1
    return max(0, ceil(n * threshold / (2 - threshold) - (gram - 1) * blocks - 1e-9))


def _shares_grams(q: str, p: str, need: int, gram: int) -> bool:
    grams = len(q) - gram + 1
    misses = 0
    for i in range(grams if need else 0):
        if q[i:i + gram] not in p:
            misses += 1
            if grams - misses < need:
                return False
    return True


def may_reach(quote: str, passage: str, threshold: float, gram: int = 6) -> bool:
    """Necessary condition for a part of `passage` to reach the threshold."""
    q, p = normalize(quote), normalize(passage)
    return _shares_grams(q, p, shared_grams_needed(len(q), threshold, gram), gram)


def sentence_may_reach(quote: str, passage: str, threshold: float, gram: int = 6) -> bool:
    """Necessary condition for an expanded match in `passage` to reach the threshold.

    An expanded match never crosses the end of a sentence, so one stretch between
    two of them has to hold the grams and, in order, the characters that the
    threshold asks for.
    """
    q = normalize(quote)
    grams = shared_grams_needed(len(q), threshold, gram)
    least = len(q) * threshold / (2 - threshold) - 1e-9
    for part in _stretches(passage):
        # A lower-case letter may be two characters.
        if 2 * len(part) >= least and len(flat := normalize(part)) >= least and _shares_grams(
                q, flat, grams, gram) and Bound(q).common(flat) >= least:
            return True
    return False


def _live_blocks(bound: Bound, passage: str, stride: int) -> list[bool]:
    """Per stretch of window starts, whether any window there may reach the
    least ratio: the common subsequence of a block bounds all windows in it."""
    n = bound.size
    need = FUZZY_MIN * (n + int(n * 0.9)) / 2
    return [bound.common(passage[at:at + stride + int(n * 1.1)]) >= need for at in range(0, len(passage), stride)]


def _window_match(quote: str, passage: str):
    q, p = quote.lower(), passage.lower()
    bound = Bound(q)
    best, span = 0.0, None
    n = len(quote)
    stride = max(8, n // 3)
    live = _live_blocks(bound, p, stride)
    if not any(live):
        return None
    for size in (n, int(n * 0.9), int(n * 1.1)):
        if size < MIN_WINDOW:
            continue
        step = max(1, size // 10)
        start = 0
        while start <= len(passage) - size:
            if not live[min(start // stride, len(live) - 1)]:
                start += step
                continue
            window = p[start:start + size]
            common = bound.common(window)
            need = max(best, FUZZY_MIN) * (n + size) / 2
            if common < need:
                # A shift by one character adds at most one common character.
                start += step * max(1, ceil((need - common) / step))
                continue
            ratio = SequenceMatcher(None, q, window).ratio()
            if ratio > best:
                best, span = ratio, (start, start + size)
            start += step
    return ("fuzzy", *span, best) if best >= FUZZY_MIN else None


def _phrase_match(phrases, passage: str):
    low = passage.lower()
    hits = []
    for phrase in phrases:
        phrase = phrase.strip()
        if len(phrase) >= MIN_PHRASE and (at := low.find(phrase.lower())) >= 0:
            hits.append((at, at + len(phrase)))
    if not hits:
        return None
    return ("phrase", max(0, min(h[0] for h in hits) - PHRASE_PAD),
            min(len(passage), max(h[1] for h in hits) + PHRASE_PAD), len(hits) / len(phrases))


def _block_match(quote: str, passage: str):
    if len(quote) < MIN_WINDOW:
        return None
    blocks = SequenceMatcher(None, quote.lower(), passage.lower()).get_matching_blocks()
    longest = max(blocks, key=lambda b: b.size)
    if longest.size < MIN_BLOCK:
        return None
    return ("lcs", max(0, longest.b - PHRASE_PAD),
            min(len(passage), longest.b + longest.size + PHRASE_PAD),
            min(longest.size / len(quote), BLOCK_CONFIDENCE_CAP))


def _overlap_match(quote: str, passage: str):
    wanted = set(_WORD4.findall(quote.lower()))
    if len(wanted) < MIN_OVERLAP_WORDS:
        return None
    size = min(len(quote) * 2, 500)
    best, span = 0, (0, 0)
    for start in range(0, len(passage) - 100, 50):
        end = min(start + size, len(passage))
        shared = len(wanted.intersection(_WORD4.findall(passage[start:end].lower())))
        if shared > best:
            best, span = shared, (start, end)
    if not best or best < len(wanted) * OVERLAP_SHARE:
        return None
    return ("word_overlap", *span, best / len(wanted))


def _word_start(text: str, at: int) -> int:
    """Where the run of letters, digits and dots that ends before a place begins."""
    while at > 0 and (text[at - 1].isalnum() or text[at - 1] == "."):
        at -= 1
    return at


def _ends_sentence(text: str, at: int) -> bool:
    if text[at] != ".":
        return True
    word = text[_word_start(text, at):at].strip(".").lower()
    return not (word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()))


def _stretches(text: str):
    """The text from each sentence end to the next."""
    at = 0
    for m in _STOP.finditer(text):
        if _ends_sentence(text, m.start()):
            yield text[at:m.start() + 1]
            at = m.start() + 1
    yield text[at:]


def _is_boundary_line(line: str) -> bool:
    """Blank, or short and without closing punctuation, as headings are."""
    s = line.strip()
    return not s or (len(s) <= 80 and len(s.split()) <= 9 and s[-1] not in ".!?;,")


def expand_sentence(text: str, start: int, end: int) -> tuple[int, int]:
    """The sentence a span begins in, never crossing a heading or blank line."""
    first = 0
    for m in _STOP.finditer(text, 0, min(len(text), start + 1)):
        if m.start() < start and _ends_sentence(text, m.start()):
            first = m.start() + 1
    line_end = text.rfind("\n", 0, start)
    while line_end >= first and line_end >= 0:
        line_start = text.rfind("\n", 0, line_end) + 1
        if _is_boundary_line(text[line_start:line_end]):
            first = line_end + 1
            break
        line_end = line_start - 1
    while first < min(len(text), end) and text[first].isspace():
        first += 1
    last = len(text)
    begin = max(start, first)
    for m in _STOP.finditer(text, begin):
        if _ends_sentence(text, m.start()):
            last = m.start() + 1
            break
    gap = text.find("\n\n", begin, last)
    if gap >= 0:
        last = gap
    sentence = text[first:last].strip()
    if not sentence:
        return start, start + len(text[start:end].strip())
    return first, first + len(sentence)


def key_phrases(quote: str) -> list[str]:
    words = quote.split()
    if len(words) < 6:
        return []
    picks = [words[:5], words[-5:]]
    if len(words) >= 12:
        mid = len(words) // 2
        picks.append(words[mid - 2:mid + 3])
    return [" ".join(p) for p in picks]


def approximate_match(quote: str, passage: str, expand: bool = True):
    """(method, start, end, confidence) of the first strategy that succeeds."""
    found = _window_match(quote, passage)
    if not found and (phrases := key_phrases(quote)):
        found = _phrase_match(phrases, passage)
    found = found or _block_match(quote, passage) or _overlap_match(quote, passage)
    if not found:
        return None
    method, start, end, confidence = found
    if expand:
        start, end = expand_sentence(passage, start, end)
        method += "+sentence"
    return method, start, end, confidence


def best_windows(quote: str, text: str, threshold: float, top: int = 5):
    """Windows of the quote's length with the highest ratio, best first.

    A shift by one character changes the common characters by at most one, so
    two measured windows bound all between them. The stretch with the highest
    bound is halved first, until no bound can enter the list any more.
    """
    q, t, n = quote.lower(), text.lower(), len(quote)
    if n == 0 or len(t) < n:
        return []
    bound, need, last = Bound(q), threshold * n, len(t) - n
    # Heap of (-bound, start, end, common at the start, common at the end) of the windows strictly between;
    # a window itself ends where it starts.
    open_: list[tuple[int, int, int, int, int]] = []

    def add(a: int, b: int, at_a: int, at_b: int) -> None:
        reach = min(at_a + b - a - 1, at_b + b - a - 1, (at_a + at_b + b - a) // 2, n)
        if b - a > 1 and reach >= need:
            heappush(open_, (-reach, a, b, at_a, at_b))

    def measure(start: int) -> int:
        common = bound.common(t[start:start + n])
        if common >= need:
            heappush(open_, (-common, start, start, common, common))
        return common

    start, common = 0, measure(0)
    while start < last:
        further = min(last, start + max(1, n // 8 if common >= need else ceil(need - common)))
        at = measure(further)
        add(start, further, common, at)
        start, common = further, at
    best: list[tuple[float, int]] = []
    while open_:
        negative, a, b, at_a, at_b = heappop(open_)
        if len(best) == top and -negative / n < -best[-1][0]:
            break
        if a < b:
            middle = (a + b) // 2
            at = measure(middle)
            add(a, middle, at_a, at)
            add(middle, b, at, at_b)
            continue
        ratio = SequenceMatcher(None, q, t[a:a + n]).ratio()
        if ratio >= threshold:
            best = sorted([*best, (-ratio, a)])[:top]
    return [(s, s + n, -r) for r, s in best]


class Wanted:
    """A quotation, prepared to tell which texts can hold it with a confidence of `least` or more.

    Each strategy has a condition on the whole text that any match of its own
    satisfies, so a text that meets none is never a holder.
    """

    def __init__(self, quote: str, least: float):
        low = quote.lower()
        n = len(quote)
        self.flat = normalize(quote)
        # Windows: as many characters in order as the smallest one needs.
        self.bound = Bound(low) if int(n * 1.1) >= MIN_WINDOW else None
        self.need = FUZZY_MIN * (len(low) + int(n * 0.9)) / 2
        self.stride, self.reach = max(8, n // 3), max(8, n // 3) + int(n * 1.1)
        phrases = [p.strip().lower() for p in key_phrases(quote)]
        self.phrases = [p for p in phrases if len(p) >= MIN_PHRASE]
        self.phrases_needed = max(1, ceil(least * len(phrases) - 1e-9))
        # A common run of `run` characters covers one of the pieces that start at every half of it.
        run = max(MIN_BLOCK, ceil(least * n - 1e-9))
        half = run // 2
        self.pieces = [low[i:i + half] for i in range(0, len(low) - half + 1, half)] if n >= MIN_WINDOW else []
        # A window may cut a word of the text, so words are looked for inside of words.
        found = set(_WORD4.findall(low))
        self.words = found if len(found) >= MIN_OVERLAP_WORDS else set()
        self.words_needed = max(1, ceil(max(least, OVERLAP_SHARE) * len(found) - 1e-9))

    def may_stand_in(self, low: str, flat: str) -> bool:
        """low: the text in lower case; flat: the normalised text."""
        if self.flat and self.flat in flat or any(p in low for p in self.pieces):
            return True
        if sum(p in low for p in self.phrases) >= self.phrases_needed or sum(w in low for w in self.words) >= self.words_needed:
            return True
        at = 0
        while self.bound and at < len(low):
            common = self.bound.common(low[at:at + self.reach])
            if common >= self.need:
                return True
            # A block further on has at most as many common characters more as it has new ones.
            at += self.stride * max(1, ceil((self.need - common) / self.stride))
        return False


def possible_holders(quotes: list[str], text: str, least: float) -> list[int]:
    """Places of the quotations that the text may hold."""
    low, flat = text.lower(), normalize(text)
    return [i for i, q in enumerate(quotes) if _wanted(q, least).may_stand_in(low, flat)]


@lru_cache(4096)
def _wanted(quote: str, least: float) -> Wanted:
    return Wanted(quote, least)
