"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACED, annotate, raw_texts, slices, words_of

KINDS = ("email", "ip", "card", "phone")
TAGS = ("other", *KINDS)

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_PART = re.compile(r"[0-9]+")

#: A small labelled table: sentences with marked spans, ``[kind text]``. ``{d}`` stands for a digit, ``{w}`` for a word.
LABELLED = (
    "write to [email {w}.{w}@{w}.com] today", "mail [email {w}{d}{d}@{w}.example.org] or call", "contact: [email {w}_{w}@{w}.co.uk] for more",
    "{w} {w} [email {w}@mail{d}.{w}.com] {w} {w}", "{w} [email {w}.{d}{d}@mail{d}.example.com] {w}, {w}", "send it to [email {w}@localhost] please",
    "the server [ip {d}{d}.{d}{d}{d}.{d}.{d}{d}] answered", "{w} {w} [ip 1{d}{d}.{d}{d}.{d}.{d}] {w} {w}", "from [ip 10.{d}.{d}.{d}] to {w}",
    "{w} ip [ip {d}{d}.{d}{d}.1{d}{d}.{d}{d}] {w}", "card [card 4{d}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d}] expires", "{w} [card 5{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}] {w}",
    "paid with [card 4{d}{d}{d}-{d}{d}{d}{d}-{d}{d}{d}{d}-{d}{d}{d}{d}] {w}", "{w} {w} [card 3{d}{d}{d} {d}{d}{d}{d}{d}{d} {d}{d}{d}{d}{d}] {w}",
    "{w} [phone +1 ({d}{d}{d}) 555-{d}{d}{d}{d}] {w} {w}", "call [phone +{d}{d} {d}{d}{d} {d}{d}{d}{d}{d}] now", "phone [phone ({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d}] {w}",
    "{w} tel. [phone +{d}{d}-{d}{d}{d}-{d}{d}{d}{d}] {w}", "reach me at [phone ({d}{d}{d}) 555-{d}{d}{d}{d}] {w}", "{w} {w} [phone {d}{d}{d}-{d}{d}{d}-{d}{d}{d}{d}] {w}",
    "in {d}{d}{d}{d} the {w} {w} of {w}", "version {d}.{d} of {w}", "{w} {d}.{d}.{d} {w} {w}", "page {d}{d}, line {d}", "it cost ${d}{d}.{d}{d} in {w}",
    "on {d}{d}{d}{d}-{d}{d}-{d}{d} {w} {w}", "{w} {d}{d}/{d}{d}/{d}{d}{d}{d} {w}", "at {d}{d}:{d}{d} {w} {w}", "{w} {d}{d}% of {w} {w}", "{d}{d}{d},{d}{d}{d} people {w}",
    "{w} token = \"{d}a{d}f{d}{d}c{d}e{d}{d}b{d}\" {w}", "key {d}f{d}{d}a{d}b{d}c{d}{d}{d}d {w}", "see {w}{d}{d} and {w}-{d}", "license, version {d}.{d}.", "chapter {d} {w} {d}{d} {w}",
    "numbers {d} {d}{d} {d}{d}{d} {d}{d} {w}", "{w} @{w} {w} wrote", "a {d}{d}-{d}{d} win {w}", "({d}{d}{d}) {w} {w}", "{w} {d}{d}{d}{d} {d}{d}{d}{d} {w}", "no. {d}{d}{d}{d}{d}{d} {w} {w}",
    "room {d}{d}{d}-{d} {w}", "{w} @ {w} {d}", "isbn {d}{d}{d}-{d}-{d}{d}-{d}{d}{d}{d}{d}{d}-{d} {w}", "{d}{d}{d}{d}{d}{d}{d}{d}{d}{d} rows {w}",
)


def _luhn(digits: str) -> bool:
    double = str.maketrans("0123456789", "0246813579")
    return (sum(map(int, digits[-1::-2])) + sum(map(int, digits[-2::-2].translate(double)))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and without overlaps within a kind, in time linear in the text.

    A match that fails its kind's test goes, and the search continues after it.
    """
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return out
    if text.find(".") >= 0:
        for m in _NUMBERS.finditer(text):
            if m.group().count(".") >= 3:
                parts = list(_PART.finditer(text, m.start(), m.end()))
                for i in range(0, len(parts) - 3, 4):
                    if all(len(x := p.group().lstrip("0")) <= 3 and int(x or 0) <= 255 for p in parts[i : i + 4]):
                        out.append((parts[i].start(), 1, parts[i + 3].end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Classes of bytes whose numbers make a word's shape.
_CLASSES = {"digit": b"0123456789", "letter": bytes([*range(65, 91), *range(97, 123), *range(128, 256)]), "dot": b".", "dash": b"-", "at": b"@", "plus": b"+", "round": b"()", "other": b"/:,=\"'%$#_&*;!?<>[]{}\\|~^`"}
_BY_CLASS = {name: np.isin(np.arange(256), np.frombuffer(values, np.uint8)) for name, values in _CLASSES.items()}
_LIMITS = {"digit": (1, 2, 3, 4, 5, 7, 10, 13, 16, 20), "letter": (1, 3, 6), "dot": (1, 2, 3, 4), "dash": (1, 2, 3), "at": (1, 2), "plus": (1,), "round": (1, 2), "other": (1,)}
_BEFORE = ("card", "phone", "tel", "tel.", "call", "mail", "ip", "to", "at", "token", "version", "page")


def shapes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(word, feature) as 0 and 1: which numbers of characters of each class a word reaches, and the classes it starts with and lies wholly in."""
    columns = []
    for name, limits in _LIMITS.items():
        total = np.concatenate(([0], np.cumsum(_BY_CLASS[name][data])))
        n = total[last] - total[first]
        columns += [n >= limit for limit in limits] + [n == last - first, _BY_CLASS[name][data[first]]]
    return np.stack(columns, axis=1) if columns else np.zeros((len(first), 0), bool)


_WIDTH = sum(len(v) + 2 for v in _LIMITS.values())


@dataclass
class Crf:
    """Scores of (feature, tag), for a word's shape, its neighbours' shapes and the word before; and of (tag, next tag)."""

    emit: np.ndarray
    move: np.ndarray
    lexicon: np.ndarray

    def features(self, word: np.ndarray, previous: np.ndarray, following: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Rows of 0 and 1 for words; ``previous`` and ``following`` are shapes of neighbours, ``before`` the hash of the word before."""
        known = before[:, None] == self.lexicon[None, :]
        return np.concatenate([word, previous, following, known, np.ones((len(word), 1), bool)], axis=1).astype(np.float32)

    def viterbi(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags of many runs of words at once. ``scores`` is (word, tag); every run lies between words tagged other."""
        tags = np.zeros(len(scores), np.int8)
        back = np.zeros(scores.shape, np.int8)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        best = scores[starts] + self.move[0]
        at = 0
        finals = np.zeros(len(starts), np.int8)
        alive = len(starts)
        while True:
            ended = int(np.searchsorted(-lengths, -(at + 1), "left"))
            finals[ended:alive] = np.argmax(best[ended:alive] + self.move[:, 0], axis=1)
            alive = ended
            if not alive:
                break
            at += 1
            step = best[:alive, :, None] + self.move[None]
            back[starts[:alive] + at] = np.argmax(step, axis=1)
            best = step.max(axis=1) + scores[starts[:alive] + at]
        tags[starts + lengths - 1] = finals
        for i in range(int(lengths.max(initial=1)) - 1, 0, -1):
            n = int(np.searchsorted(-lengths, -i, "left"))
            here = starts[:n] + i
            tags[here - 1] = back[here, tags[here]]
        return tags


def _tokens(part: np.ndarray, borders: np.ndarray):
    hashes, first, last, counts = words_of(part, borders, SPACED)
    special = np.concatenate(([0], np.cumsum(_BY_CLASS["digit"][part] | _BY_CLASS["at"][part])))
    return hashes, first, last, counts, special[last] > special[first] if len(first) else np.zeros(0, bool)


def _rows(crf: Crf, part: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray, counts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Features of the chosen words; neighbours are those of the same text."""
    text = np.searchsorted(counts, chosen, "right") - 1
    has_previous, has_next = chosen > counts[text], chosen + 1 < counts[text + 1]
    previous, following = np.maximum(chosen - 1, 0), np.minimum(chosen + 1, len(first) - 1)
    word = shapes(part, first[chosen], last[chosen])
    left = shapes(part, first[previous], last[previous]) & has_previous[:, None]
    right = shapes(part, first[following], last[following]) & has_next[:, None]
    return crf.features(word, left, right, np.where(has_previous, hashes[previous], 0))


def _lexicon() -> np.ndarray:
    data, offsets = raw_texts(pa.array(list(_BEFORE)))
    return words_of(data, offsets, SPACED)[0]


def train(labelled: tuple[str, ...] | list[str] = LABELLED, *, copies: int = 12, steps: int = 300, l2: float = 1e-3, seed: int = 5) -> Crf:
    """Fit the field to a small labelled table by the gradient of the log-likelihood (forward and backward sums).

    Each sentence is filled ``copies`` times with random digits and words. Words without a digit or an @ are tagged
    other by construction, so they cut sentences into runs, in training as in decoding.
    """
    random = np.random.default_rng(seed)
    texts, marks = [], []
    for sentence in labelled:
        for _ in range(copies):
            filled = re.sub(r"\{d\}", lambda _: str(random.integers(10)), sentence)
            filled = re.sub(r"\{w\}", lambda _: "".join(chr(97 + x) for x in random.integers(0, 26, random.integers(2, 9))), filled)
            text, spans = "", []
            for piece in re.split(r"(\[(?:email|ip|card|phone) [^\]]*\])", filled):
                if m := re.fullmatch(r"\[(\w+) (.*)\]", piece):
                    spans.append((len(text), len(text) + len(m[2]), TAGS.index(m[1])))
                    text += m[2]
                else:
                    text += piece
            texts.append(text)
            marks.append(spans)
    data, offsets = raw_texts(pa.array(texts))
    hashes, first, last, counts, special = _tokens(data, offsets)
    crf = Crf(np.zeros((3 * _WIDTH + len(_BEFORE) + 1, len(TAGS))), np.zeros((len(TAGS), len(TAGS))), _lexicon())
    chosen = np.flatnonzero(special)
    x = _rows(crf, data, hashes, first, last, counts, chosen).astype(np.float64)
    text = np.searchsorted(counts, chosen, "right") - 1
    gold = np.zeros(len(chosen), np.int64)
    for i, (t, c) in enumerate(zip(text, chosen)):
        for a, b, tag in marks[t]:
            if a <= first[c] - offsets[t] < b:
                gold[i] = tag
    opens = np.ones(len(chosen), bool)
    opens[1:] = (np.diff(chosen) > 1) | (np.diff(text) > 0)
    starts = np.flatnonzero(opens)
    lengths = np.diff(np.append(starts, len(chosen)))
    k = len(TAGS)
    true_move = np.zeros((k, k))
    closes = np.append(starts[1:], len(chosen)) - 1
    np.add.at(true_move, (np.where(opens, 0, np.roll(gold, 1)), gold), 1)
    np.add.at(true_move, (gold[closes], np.zeros(len(closes), int)), 1)
    hot = np.eye(k)[gold]
    m = [np.zeros_like(crf.emit), np.zeros_like(crf.move)]
    v = [np.zeros_like(crf.emit), np.zeros_like(crf.move)]
    for step in range(1, steps + 1):
        potential, moves = np.exp(np.clip(x @ crf.emit, -30, 30)), np.exp(crf.move)
        belief, expected = np.zeros_like(potential), np.zeros((k, k))
        for n in np.unique(lengths):
            at = starts[lengths == n][:, None] + np.arange(n)
            p = potential[at]
            ahead, behind = np.zeros_like(p), np.zeros_like(p)
            ahead[:, 0] = moves[0] * p[:, 0]
            for i in range(1, n):
                ahead[:, i] = (ahead[:, i - 1] @ moves) * p[:, i]
                ahead[:, i] /= ahead[:, i].sum(axis=1, keepdims=True)
            behind[:, n - 1] = moves[:, 0]
            for i in range(n - 2, -1, -1):
                behind[:, i] = (behind[:, i + 1] * p[:, i + 1]) @ moves.T
                behind[:, i] /= behind[:, i].sum(axis=1, keepdims=True)
            both = ahead * behind
            belief[at] = both / both.sum(axis=2, keepdims=True)
            for i in range(1, n):
                pair = ahead[:, i - 1, :, None] * moves[None] * (p[:, i] * behind[:, i])[:, None, :]
                expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            expected[0] += belief[at[:, 0]].sum(axis=0)
            expected[:, 0] += belief[at[:, n - 1]].sum(axis=0)
        count = len(starts)
        gradients = [x.T @ (hot - belief) / count - l2 * crf.emit, (true_move - expected) / count - l2 * crf.move]
        for i, (weights, g) in enumerate(zip((crf.emit, crf.move), gradients)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            weights += 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return crf


def _plausible(kind: int, text: str) -> bool:
    """What the field finds must also keep the rules of its kind: numbers hold no letters, cards pass their check digit."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == 0:
        return text.count("@") == 1 and not text.startswith("@") and not text.endswith("@")
    if any(c.isalpha() for c in text):
        return False
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return 13 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def find(documents: DataFrame, crf: Crf, *, text_column: str = "text") -> DataFrame:
    """``documents`` with ``base`` and ``spans``: arrays of (start, kind, stop), in code points, the end exclusive.

    ``base`` are the matches of the fixed patterns. The field then tags all words with a digit or an @ in their context,
    by Viterbi over all runs of such words of a batch at once; what it finds, trimmed of punctuation, is added where no
    base span is. Whole texts are read, in place, in time linear in their length.

    Null and empty texts have no spans; repeated rows each have theirs.
    """

    def run(column: pa.Array) -> list:
        base: list[list[tuple]] = [[] for _ in range(len(column))]
        every: list[list[tuple]] = [[] for _ in range(len(column))]
        data, offsets = raw_texts(column)
        for begin, end in slices(offsets):
            part, borders = data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
            hashes, first, last, counts, special = _tokens(part, borders)
            chosen = np.flatnonzero(special)
            if not len(chosen):
                continue  # no digit and no @ in any of these texts
            text = np.searchsorted(counts, chosen, "right") - 1
            opens = np.ones(len(chosen), bool)
            opens[1:] = (np.diff(chosen) > 1) | (np.diff(text) > 0)
            scores = np.concatenate([_rows(crf, part, hashes, first, last, counts, chosen[i : i + 65536]) @ crf.emit for i in range(0, len(chosen), 65536)])
            starts = np.flatnonzero(opens)
            tags = crf.viterbi(scores, starts, np.diff(np.append(starts, len(chosen))))
            edge = opens.copy()
            edge[1:] |= tags[1:] != tags[:-1]
            head = np.flatnonzero(edge)
            tail = np.append(head[1:], len(chosen)) - 1
            added: dict[int, list[tuple[int, int, int]]] = {}
            for h, t in zip(head[tags[head] > 0], tail[tags[head] > 0]):
                added.setdefault(int(text[h]), []).append((int(first[chosen[h]]), int(last[chosen[t]]), int(tags[h]) - 1))
            for row in np.unique(text).tolist():
                raw = part[borders[row] : borders[row + 1]].tobytes()
                body = raw.decode("utf-8", "replace")
                found = base_spans(body)
                extra = []
                for a, b, kind in added.get(row, []):
                    piece = raw[a - borders[row] : b - borders[row]].decode("utf-8", "replace")
                    left = len(piece) - len(piece.lstrip(" \t\n\r\x0b\x0c.,;:!?\"'<>[]{}"))
                    kept = piece.strip(" \t\n\r\x0b\x0c.,;:!?\"'<>[]{}")
                    start = len(raw[: a - borders[row]].decode("utf-8", "replace")) + left
                    stop = start + len(kept)
                    if _plausible(kind, kept) and not any(s < stop and start < e for s, _, e in found):
                        extra.append((start, kind, stop))
                base[begin + row], every[begin + row] = found, sorted(found + extra)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
        rows = lambda spans: pa.array([[{"start": a, "kind": k, "stop": b} for a, k, b in s] for s in spans], kind)
        return [rows(base), rows(every)]

    fields = "array<struct<start: int, kind: int, stop: int>>"
    return annotate(documents, text_column, run, f"base {fields}, spans {fields}")


def as_text(spans):
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
