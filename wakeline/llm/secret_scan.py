"""Secrets by fixed patterns, and by a linear-chain conditional random field that adds what these miss.

Tokens are runs of letters, digits, + / _ . - and bytes beyond ASCII. The field tags each token as the begin or inside of
a secret or outside. Its features are the token's shape, the shapes and words of its neighbours, what stands between
them (=, :, quotes) and how much of the text is digits. It learns from the secrets that the patterns find in a bounded
sample of the texts, by the exact gradient of the conditional likelihood. Every other secret is learned with the
patterns' own cues hidden (the words beside it, and what stands between), so that the field must know a secret by its
looks and its surroundings as well, and finds those that no pattern does.

Viterbi decoding is exact and yet skips most tokens: where outside beats the other tags by more than any two
transitions could make good, the best path is outside there, and the chain falls apart into short pieces.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm._bytes import each, pieces, words
from wakeline.llm._shared import draw, texts

# The patterns, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "crf")

OUT, BEGIN, INSIDE = 0, 1, 2
_GAP = np.ones(256, bool)
for _c in (*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_.-"), *range(128, 256)):
    _GAP[_c] = False
_CLASS = np.full(256, 3, np.uint8)  # digit, upper, lower, other
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 0, 1, 2
_NOT_HEX = np.ones(256, np.uint8)
_NOT_HEX[[*range(48, 58), *range(97, 103), *range(65, 71)]] = 0
_OTHER_THAN_HEX = np.ones(256, bool)
_OTHER_THAN_HEX[[*range(48, 58), *range(97, 103)]] = False
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
N_SHAPES, N_WORDS, N_GAPS, N_FILES = 2048, 4096, 8, 32
#: The features that hold the patterns' cues: the words of the token and before it, and what stands around it.
CUES = [3, 4, 5, 6]
#: Chains that one text of the sample teaches at most.
CHAINS = 16
#: Where each kind of feature begins among the weights.
_SIZES = [N_SHAPES, N_SHAPES, N_SHAPES, N_WORDS, N_WORDS, N_GAPS, N_GAPS, N_FILES]
_AT = np.concatenate([[0], np.cumsum(_SIZES)])


def base_spans(text: str, hexed: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) in code points, sorted; only what is long enough. hexed: whether to look for hex."""
    found = []
    if ("=" in text or ":" in text) and any(k in (low := text.lower()) for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if hexed:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def long_hex(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text whether 16 bytes in a row are 0-9 or a-f; a run across two texts may mark the first for nothing."""
    other = np.flatnonzero(_OTHER_THAN_HEX[data])
    before = np.concatenate([[-1], other])
    at = before[np.diff(np.append(before, len(data))) > 16] + 1
    out = np.zeros(len(offsets) - 1, bool)
    for k in at.tolist():  # a run may begin in one text and go on in the next ones
        row = int(np.searchsorted(offsets, k, "right")) - 1
        while row < len(out) and offsets[row] < len(data) and (offsets[row] <= k or not _OTHER_THAN_HEX[data[k : offsets[row]]].any()):
            out[row] = True
            row += 1
    return out


def _taught(text: str) -> list[tuple[int, int]]:
    """The secrets themselves, for teaching: of an assignment its value alone."""
    out = [(s, e) for s, k, e in base_spans(text) if k]
    return out + [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, the number of tokens before each text, and (tokens, 8) feature numbers."""
    starts, ends, at = words(data, offsets, _GAP)
    n = len(starts)
    if not n:
        return starts, ends, at, np.zeros((0, len(_SIZES)), np.int64)
    kind = _CLASS[data]
    sums = np.zeros(len(data) + 1, np.int32)

    def of(x: np.ndarray) -> np.ndarray:
        """The sum over each token."""
        np.cumsum(x, out=sums[1:], dtype=np.int32)
        return sums[ends] - sums[starts]

    length = ends - starts
    has = [of(kind == k) > 0 for k in range(4)]
    changes = np.zeros(len(data), bool)
    changes[1:] = kind[1:] != kind[:-1]
    changes[starts] = False
    flips = np.digitize(of(changes), [1, 3, 6])
    hexed = of(_NOT_HEX[data]) == 0
    shape = ((((has[0].astype(np.int64) * 2 + has[1]) * 2 + has[2]) * 2 + has[3]) * 2 + hexed) * 32 + np.digitize(length, [4, 8, 12, 16, 20, 32, 48]) * 4 + flips
    # a word's hash is a sum over its bytes and places; tokens of over 12 bytes have no word
    short = length <= 12
    code = np.zeros(n, np.int64)
    for k in range(12):
        has_k = np.flatnonzero(short & (length > k))
        code[has_k] += _LOWER[data[starts[has_k] + k]].astype(np.int64) * (2 * k + 1) * 40503
    word = np.where(short, code % 4093 + 1, 0)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first[1:], first[0] = own[1:] != own[:-1], True
    last[:-1], last[-1] = own[1:] != own[:-1], True
    prev = lambda x: np.where(first, 0, np.concatenate([[0], x[:-1]]))
    nxt = lambda x: np.where(last, 0, np.concatenate([x[1:], [0]]))
    at_mark = [np.flatnonzero(m) for m in (data == 61, data == 58, (data == 34) | (data == 39))]
    gap_from = np.where(first, offsets[own], np.concatenate([[0], ends[:-1]]))
    gap = np.zeros(n, np.int64)
    for i, m in enumerate(at_mark):
        of_token = np.searchsorted(starts, m)
        ahead = of_token < n
        of_token = of_token[ahead]
        gap[of_token[m[ahead] >= gap_from[of_token]]] |= 1 << i
    text_bytes = np.maximum(np.diff(offsets), 1)
    digits = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind == 0, out=digits[1:], dtype=np.int32)
    density = np.digitize((digits[offsets[1:]] - digits[offsets[:-1]]) / text_bytes, [0.002, 0.01, 0.05])[own]
    files = density * 8 + np.digitize(length, [8, 12, 16, 20]) * 1 * has[0]
    columns = [shape, prev(shape), nxt(shape), word, prev(word), gap, nxt(gap), files]
    return starts, ends, at, np.stack([c + _AT[i] for i, c in enumerate(columns)], axis=1)


@dataclass
class Field:
    weights: np.ndarray  # (features, 3)
    moves: np.ndarray  # (3, 3), from one tag to the next

    def decode(self, found: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The best tags of all texts of a piece, each text a chain of its own that begins and ends outside."""
        score = self.weights[found[:, 0]]
        for i in range(1, found.shape[1]):
            score = score + self.weights[found[:, i]]
        tags = np.zeros(len(score), np.int8)
        a = self.moves
        # what tag y could gain at most over outside: with outside or begin next, and with inside next, where that one
        # would have to be a begin instead
        after = np.full(len(score), -np.inf)
        after[:-1] = score[1:, INSIDE] - score[1:, BEGIN]
        open_ = np.zeros(len(score), bool)
        for y in (BEGIN, INSIDE):
            enter = max(a[p, y] - a[p, OUT] for p in range(3) if a[p, y] > -1e5)
            leave = max(a[y, q] - a[OUT, q] for q in (OUT, BEGIN))
            go_on = a[y, INSIDE] - a[OUT, BEGIN] + max(a[INSIDE, q] - a[BEGIN, q] for q in range(3))
            open_ |= score[:, OUT] - score[:, y] <= enter + np.maximum(leave, go_on + after)
        spots = np.flatnonzero(open_)
        if len(spots):
            own = np.searchsorted(at, spots, "right")
            cuts = np.flatnonzero((np.diff(spots) > 1) | (np.diff(own) > 0)) + 1
            for part in np.split(spots, cuts):
                tags[part] = self._path(score[part])
        return tags

    def _path(self, score: np.ndarray) -> list[int]:
        best, back = self.moves[OUT] + score[0], []
        for row in score[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(0))
            best = step.max(0) + row
        tag = int((best + self.moves[:, OUT]).argmax())
        path = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            path.append(tag)
        return path[::-1]


def fit(found: list[np.ndarray], tags: list[np.ndarray], weights: np.ndarray, steps: int = 80, ridge: float = 1e-3) -> Field:
    """The field of greatest penalised likelihood for weighted chains of features and tags, by Adagrad on the exact
    gradient, all chains side by side."""
    n, longest = len(found), max(map(len, found))
    f = np.zeros((len(_SIZES), n, longest), np.int32)
    y = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for i, (x, t) in enumerate(zip(found, tags, strict=True)):
        f[:, i, : len(x)], y[i, : len(x)], mask[i, : len(x)] = x.T, t, True
    allowed = np.ones((3, 3))
    allowed[OUT, INSIDE] = 0
    w, a = np.zeros((_AT[-1], 3)), np.zeros((3, 3))
    gw, ga = np.full_like(w, 1e-8), np.full_like(a, 1e-8)
    heavy = weights[:, None, None]
    truth = np.eye(3)[y] * mask[..., None]
    both = mask[:, :-1] & mask[:, 1:]
    moved = np.zeros((3, 3))
    np.add.at(moved, (np.where(both, y[:, :-1], 0), y[:, 1:]), both * weights[:, None])
    shrink = ridge * weights.sum() / 100
    for _ in range(steps):
        score = w[f[0]]
        for k in range(1, len(f)):
            score += w[f[k]]
        score = np.exp(np.clip(score, -30, 30))
        move = np.exp(np.clip(a, -20, 20)) * allowed
        alpha, scale = np.zeros((n, longest, 3)), np.ones((n, longest))
        for t in range(longest):
            x = (move[OUT] if t == 0 else alpha[:, t - 1] @ move) * score[:, t]
            scale[:, t] = np.where(mask[:, t], x.sum(1), 1)
            alpha[:, t] = np.where(mask[:, t, None], x / scale[:, t, None], alpha[:, t - 1] if t else 0)
        beta, pairs = np.ones((n, longest, 3)), np.zeros((3, 3))
        for t in range(longest - 2, -1, -1):
            ahead = beta[:, t + 1] * score[:, t + 1] / scale[:, t + 1, None]
            live = mask[:, t + 1]
            beta[:, t] = np.where(live[:, None], ahead @ move.T, 1)
            pairs += ((alpha[live, t] * weights[live, None]).T @ ahead[live]) * move
        chance = alpha * beta * mask[..., None]
        chance /= np.maximum(chance.sum(2, keepdims=True), 1e-12)
        grad = shrink * w
        diff = ((chance - truth) * heavy).reshape(-1, 3)
        for c in range(3):
            for k in range(len(f)):
                grad[:, c] += np.bincount(f[k].ravel(), diff[:, c], len(w))
        step_a = pairs - moved + shrink * a
        gw += grad**2
        ga += step_a**2
        w -= 0.5 * grad / np.sqrt(gw)
        a -= 0.5 * step_a / np.sqrt(ga)
    return Field(w.astype(np.float32), np.where(allowed > 0, a, -1e6))


def lessons(text: str, data: np.ndarray, offsets: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(features, tags, weight) of the chains that a text teaches: the tokens around each secret of the patterns, once as
    they are and once with the cues hidden, and those around one token drawn by a hash of the text, which stand for all
    the text's tokens."""
    starts, ends, _, found = features(data, offsets)
    if not len(starts):
        return
    code_at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first, last = code_at[starts], code_at[ends]
    tag = np.zeros(len(starts), np.int8)
    for s, e in _taught(text):
        inside = np.arange(np.searchsorted(last, s, "right"), np.searchsorted(first, e, "left"))
        tag[inside] = INSIDE
        tag[inside[:1]] = BEGIN
    hidden = found.copy()
    hidden[:, CUES] = _AT[CUES]
    any_one = int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big") % len(starts)
    for k in [any_one, *np.flatnonzero(tag == BEGIN).tolist()]:
        lo, hi = max(0, k - reach), min(len(starts), k + reach)
        while lo and tag[lo] == INSIDE:
            lo -= 1
        if tag[lo:hi].any():
            yield found[lo:hi], tag[lo:hi], 1.0
            yield hidden[lo:hi], tag[lo:hi], 1.0
        else:
            for x in (found, hidden):
                yield x[lo:hi], tag[lo:hi], len(starts) / (hi - lo) / 2


def trusted_lessons(chains: list[tuple[np.ndarray, np.ndarray, float]]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The chains without those in which a token counts as outside although most tokens of its shape are secrets: no
    pattern has found it, which does not tell that it is none."""
    shape = np.concatenate([f[:, 0] for f, _, _ in chains])
    outside = np.concatenate([t == OUT for _, t, _ in chains])
    weight = np.repeat([w for *_, w in chains], [len(t) for _, t, _ in chains])
    often = np.bincount(shape, weight * ~outside, N_SHAPES) > np.bincount(shape, weight * outside, N_SHAPES)
    return [(f, t, w) for f, t, w in chains if not often[f[t == OUT, 0]].any()]


def train(docs: DataFrame, sample_rows: int = 10_000, reach: int = 8) -> Field | None:
    """A field from at most ``sample_rows`` different texts (doc_id, text), drawn by a hash of id and text, and the first
    ``CHAINS`` chains of each of them. None if the patterns find no secret in it. The chains, some kilobytes each, are all
    that comes to the driver."""
    drawn = draw(docs, sample_rows, [F.col("doc_id").cast("string"), F.col("text")], seed=5)

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_texts = b.column(0).to_pylist()
            chains = [x for i, data, offsets in each(b.column(0)) for x in islice(lessons(all_texts[i], data, offsets, reach), CHAINS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f.astype(np.int32).ravel() for f, _, _ in chains], pa.list_(pa.int32())), pa.array([t for _, t, _ in chains], pa.list_(pa.int8())), pa.array([w for _, _, w in chains], pa.float64())],
                ["f", "t", "w"],
            )

    got = drawn.select("text").mapInArrow(taught, "f array<int>, t array<tinyint>, w double").toArrow()
    chains = sorted(
        ((np.asarray(f.values).reshape(-1, len(_SIZES)), np.asarray(t.values), w.as_py()) for f, t, w in zip(got.column("f"), got.column("t"), got.column("w"), strict=True)),
        key=lambda x: (x[0].tobytes(), x[1].tobytes(), x[2]),
    )
    if not any(t.any() for _, t, _ in chains):
        return None
    chains = trusted_lessons(chains)
    return fit([c[0] for c in chains], [c[1] for c in chains], np.array([c[2] for c in chains]))


def field_spans(field: Field, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) in code points of each secret that the field finds, whatever the patterns do."""
    starts, ends, at, found = features(data, offsets)
    tags = field.decode(found, at)
    begin = np.flatnonzero(tags == BEGIN)
    after = np.append(np.flatnonzero(tags != INSIDE), len(tags))
    last = after[np.searchsorted(after, begin, "right")] - 1
    text = np.searchsorted(at, begin, "right") - 1
    code_at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    zero = code_at[offsets[text]]
    return text, code_at[starts[begin]] - zero, code_at[ends[last]] - zero


def _apart(start: int, end: int, starts: list[int], reached: list[int]) -> bool:
    """Whether a span meets none of those that begin at starts (sorted), reached being the furthest end so far."""
    k = bisect_left(starts, end)
    return not k or reached[k - 1] <= start


def scan_secrets(docs: DataFrame, sample_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end, in code points, by start: the patterns' spans, and of kind crf those that the field
    finds where no pattern's span is. A null text counts as empty and has no spans. Rows with the same doc_id are
    scanned each for itself; with no secret to learn from, the patterns alone are used; an empty table gives an
    empty result.
    """
    rows = texts(docs, id_col, text_col)
    field = train(rows, sample_rows)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_texts = b.column(1).to_pylist()
            hexed = np.concatenate([np.zeros(0, bool), *(long_hex(data, offsets) for _, _, data, offsets in pieces(b.column(1)))])
            spans = [base_spans(t, h) for t, h in zip(all_texts, hexed, strict=True)]
            base = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x) for x in spans]
            counts = [[sum(k == kind for _, k, _ in x) for x in spans] for kind in range(3)]
            for i, _, data, offsets in pieces(b.column(1)) if field else ():
                before: dict[int, tuple[list[int], list[int]]] = {}
                for row, start, end in zip(*(x.tolist() for x in field_spans(field, data, offsets)), strict=True):
                    if row not in before:
                        own = spans[i + row]
                        before[row] = [x for x, _, _ in own], list(accumulate((y for _, _, y in own), max))
                    if _apart(start, end, *before[row]):
                        spans[i + row].append((start, 3, end))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                    pa.array([",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(x)) for x in spans], pa.string()),
                ],
                names,
            )

    return rows.mapInArrow(scanned, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
